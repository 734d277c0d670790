import random

import pytest

from tracewise.operators.containment import contained_chain, contained_in

SCHEMA = "key string, id bigint, start bigint, end bigint"
OUTER = "key string, outer bigint, start bigint, end bigint"


def brute_force(inner, outer):
    return sorted(
        (i, o)
        for k, i, s, e in inner
        for l, o, a, b in outer
        if None not in (s, e, a, b) and k == l and s <= e and a < b and s > a and e < b
    )


def joined(spark, inner, outer):
    result = contained_in(
        spark.createDataFrame(inner, SCHEMA), spark.createDataFrame(outer, OUTER), ["key"], ["outer"]
    )
    return result


def pairs(df):
    return sorted((r["id"], r["outer"]) for r in df.collect())


def test_hand_cases(spark):
    outer = [
        ("a", 1, 100, 200),
        ("a", 2, 120, 180),  # nested
        ("a", 3, 300, None),
        ("a", 4, 500, 400),  # reversed
        ("b", 5, 100, 200),
        ("a", 6, -1000, 10**12),  # far longer than the others
        ("a", 7, -50, -10),
    ]
    inner = [
        ("a", 10, 130, 170),
        ("a", 11, 100, 150),  # touches a start
        ("a", 12, 150, 200),  # touches an end
        ("a", 13, 150, 150),  # no length
        ("a", 14, 150, None),
        ("a", 15, 310, 320),
        ("a", 16, 420, 480),
        ("b", 17, 101, 199),
        ("a", 18, 170, 130),  # reversed
        ("a", 19, -40, -20),
        ("c", 20, 150, 160),
        ("a", 21, 199, 201),
    ]
    got = pairs(joined(spark, inner, outer))
    assert got == brute_force(inner, outer)
    assert got == [
        (10, 1), (10, 2), (10, 6), (11, 6), (12, 6), (13, 1), (13, 2), (13, 6), (15, 6), (16, 6),
        (17, 5), (19, 6), (19, 7), (21, 6),
    ]


def test_no_outer_rows(spark):
    assert pairs(joined(spark, [("a", 1, 2, 3)], [])) == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_intervals_of_mixed_durations(spark, seed):
    rng = random.Random(seed)

    def interval(n):
        start = rng.randrange(-2000, 100_000)
        length = int(2 ** rng.uniform(0, rng.choice([4, 10, 16])))
        return rng.choice("ab"), n, start, rng.choice([start + length] * 9 + [None])

    inner = [interval(n) for n in range(400)]
    outer = [interval(n) for n in range(300)] + [("a", 999, -(2**62), 2**62 - 1)]
    assert pairs(joined(spark, inner, outer)) == brute_force(inner, outer)


def test_times_of_a_real_clock(spark):
    base = 1_700_000_000_000_000_000
    outer = [("a", n, base + n * 1000, base + n * 1000 + 999) for n in range(50)]
    inner = [("a", n, base + n * 1000 + 1, base + n * 1000 + 998) for n in range(50)]
    assert pairs(joined(spark, inner, outer)) == [(n, n) for n in range(50)]


def test_hot_bucket_is_split(spark):
    """Most rows in one bucket of one key: the join is split and complete."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        inner = spark.range(0, 40_000, numPartitions=8).selectExpr(
            "if(id % 3 < 2, 'hot', concat('k', id % 50)) AS key", "id",
            "1000 + id % 7 AS start", "1010 + id % 5 AS end",
        )
        outer = spark.range(50).selectExpr(
            "if(id = 0, 'hot', concat('k', id)) AS key", "id AS outer", "0L AS start",
            "5000L AS end",
        )
        result = contained_in(inner, outer, ["key"], ["outer"])
        rows = result.collect()
        plan = result._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan
    expected = inner.toPandas()
    known = expected[expected.key.isin({"hot"} | {f"k{n}" for n in range(1, 50)})]
    assert sorted(r["id"] for r in rows) == sorted(known.id)


def chained(spark, inner, middle, outer, tasks=None):
    schema = "key string, start long, end long"
    calls = spark.createDataFrame(inner, "key string, kind int, call int, inner_start long, inner_end long")
    spans = spark.createDataFrame(middle, "key string, kind int, span int, start long, end long")
    steps = spark.createDataFrame(outer, "key string, step int, start long, end long")
    sizes = spark.createDataFrame([("z", 0, 3), *[(r[0], *r[3:]) for r in middle]], schema)
    return contained_chain(calls, spans, steps, sizes, ["key"], ["kind"], ["step"], tasks)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_a_chain_equals_two_joins_of_every_row_with_every_other(spark, seed):
    """Nested, overlapping and equal intervals of mixed durations; spans that reach over a bucket."""
    rng = random.Random(seed)

    def interval(longest, *others):
        start = rng.randrange(-2000, 40_000)
        length = int(2 ** rng.uniform(0, rng.choice(longest))) - 1
        return rng.choice("ab"), *others, start, rng.choice([start + length] * 9 + [None, start - 5])

    outer = [interval([8, 15], n) for n in range(60)] + [("a", 99, -(2**60), 2**60), (None, 98, 0, 90_000)]
    middle = [interval([1, 6, 14], rng.randrange(2), n) for n in range(200)]
    middle += middle[:5] + [(None, 0, 300, 1, 50_000)]
    inner = [interval([1, 3, 9], rng.randrange(2), n) for n in range(300)]
    inner += inner[:5] + [(None, 0, 400, 5, 40_000)]

    def inside(x, y):
        known = None not in (x[0], x[-1], y[-1])
        return known and x[0] == y[0] and y[-2] < x[-2] <= x[-1] < y[-1]

    expected = []
    for s in outer:
        for m in (m for m in middle if inside(m, s)):
            expected.append((s[1], m[2], -1))
            expected += [(s[1], m[2], c[2]) for c in inner if c[1] == m[1] and inside(c, m)]
    assert len({c for *_, c in expected}) > 20
    for tasks in (None, 7):
        rows = chained(spark, inner, middle, outer, tasks).collect()
        found = [(r["step"], r["span"], -1 if r["call"] is None else r["call"]) for r in rows]
        assert sorted(found) == sorted(expected)
