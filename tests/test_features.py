import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracewise.features import bags, interaction, scoring, split, synthetic
from tracewise.operators.running_total import running_total


def test_synthetic_features(spark):
    samples = spark.range(300).withColumnRenamed("id", "sample_id")
    make = lambda df, seed=1: synthetic.synthetic_features(df, 3, [50, 2000], 6, seed)
    rows = {r["sample_id"]: r for r in make(samples).collect()}
    for r in rows.values():
        assert len(r["dense"]) == 3 and all(0 <= u < 1 for u in r["dense"])
        for ids, size in zip(r["bags"], (50, 2000), strict=True):
            assert len(set(ids)) == 6 and ids == sorted(ids) and 0 <= ids[0] and ids[-1] < size
    # Other partitions and order, same numbers; another seed, other numbers.
    again = make(samples.repartition(7).orderBy(F.desc("sample_id"))).collect()
    assert {r["sample_id"]: r for r in again} == rows
    assert make(samples, 2).filter("sample_id = 5").first() != rows[5]


def test_synthetic_features_of_large_negative_and_null_ids(spark):
    ids = [5, 5 + 2**31, 5 + 2**32, 5 + 2**62, -5, None]
    df = spark.createDataFrame([(i,) for i in ids], "sample_id bigint")
    rows = {r["sample_id"]: r for r in synthetic.synthetic_features(df, 3, [2000, 50], 4, 9).collect()}
    known = [tuple(rows[i]["dense"]) + tuple(rows[i]["bags"][0]) for i in ids if i is not None]
    assert len(set(known)) == 5
    assert rows[None]["dense"] is None and rows[None]["bags"] is None


def test_bags_larger_than_a_block(spark, monkeypatch):
    df = spark.range(40).withColumnRenamed("id", "sample_id")
    expected = sorted(map(repr, synthetic.synthetic_features(df, 2, [900, 900], 7).collect()))
    monkeypatch.setattr(synthetic, "BLOCK", 20)
    assert sorted(map(repr, synthetic.synthetic_features(df, 2, [900, 900], 7).collect())) == expected


def test_synthetic_numbers_are_spread_evenly(spark):
    samples = spark.range(4000).withColumnRenamed("id", "sample_id")
    dense = np.array(
        [r["dense"] for r in synthetic.synthetic_features(samples, 4, [10], 1).collect()]
    )
    counts, _ = np.histogram(dense.ravel(), 20, (0, 1))
    assert counts.min() > 650 and counts.max() < 950
    assert np.abs(np.corrcoef(dense.T) - np.eye(4)).max() < 0.06
    assert abs(np.corrcoef(dense[:-1, 0], dense[1:, 0])[0, 1]) < 0.06


def test_too_few_ids_raise(spark):
    samples = spark.range(3).withColumnRenamed("id", "sample_id")
    with pytest.raises(PySparkException, match="fewer than 5"):
        synthetic.synthetic_features(samples, 1, [4], 5).collect()


def test_running_total_against_brute_force(spark, staging):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), n, rng.randrange(5)) for n in range(1001)]
    df = spark.createDataFrame(rows, "g string, n bigint, x bigint").repartition(5)
    got = {
        (r["g"], r["n"]): r["t"]
        for r in running_total(
            df, ["n"], F.col("x"), "t", staging, per=["g"], partitions=6
        ).collect()
    }
    expected, sums = {}, {}
    for g, n, x in rows:
        sums[g] = sums.get(g, 0) + x
        expected[g, n] = sums[g]
    assert got == expected


def test_bag_offsets(spark, staging):
    rows = [(s, t, list(range((s * 7 + t) % 4))) for s in range(200) for t in range(2)]
    df = spark.createDataFrame(rows, "sample_id bigint, table_id int, ids array<bigint>")
    offsets = bags.bag_offsets(bags.bag_sizes(df), staging)
    got = {(r["table_id"], r["sample_id"]): r["offset"] for r in offsets.collect()}
    for t in range(2):
        start = 0
        for s in range(200):
            assert got[t, s] == start
            start += (s * 7 + t) % 4
    flat = bags.flatten_bags(df)
    assert flat.count() == sum(len(ids) for _, _, ids in rows)
    assert flat.filter("pos != idx").count() == 0


def test_hash_ids(spark):
    df = spark.createDataFrame([(-1, 12, 7)], "a bigint, b bigint, c bigint")
    assert tuple(bags.hash_ids(df, {"a": 10, "b": 5}).first()) == (9, 2, 7)
    assert tuple(bags.hash_ids(df, 4, ["a", "b", "c"]).first()) == (3, 0, 3)


def test_embedding_bag_sum(spark):
    ids = spark.createDataFrame(
        [(1, 0, 5), (1, 0, 6), (1, 0, 5), (1, 1, 5), (2, 0, None), (3, 0, 99), (3, 0, 6)],
        "sample_id bigint, table_id int, idx bigint",
    )
    table = spark.createDataFrame(
        [(0, 5, [1.0, 2.0]), (0, 6, [10.0, 20.0]), (1, 5, [0.5, 0.25])],
        "table_id int, idx bigint, vector array<double>",
    )
    got = {
        (r["sample_id"], r["table_id"]): (r["pooled"], r["missing"])
        for r in bags.embedding_bag_sum(ids, table, 2).collect()
    }
    assert got == {
        (1, 0): ([12.0, 24.0], 0), (1, 1): ([0.5, 0.25], 0), (2, 0): ([0.0, 0.0], 0),
        (3, 0): ([10.0, 20.0], 1),
    }


@pytest.mark.parametrize("vector", [[1.0], [1.0, 2.0, 3.0], []])
def test_embedding_bag_sum_refuses_other_widths(spark, vector):
    ids = spark.createDataFrame([(1, 0, 5)], "sample_id bigint, table_id int, idx bigint")
    table = spark.createDataFrame([(0, 5, vector)], "table_id int, idx bigint, vector array<double>")
    with pytest.raises(Exception, match="vector is not 2 wide"):
        bags.embedding_bag_sum(ids, table, 2).collect()


@pytest.mark.parametrize("block", [1, 1 << 12, 32 << 20])
@pytest.mark.parametrize("kind", ["bigint", "float"])
def test_embedding_bag_sum_against_plain_sums(spark, monkeypatch, block, kind):
    """Wide vectors, a large bag that many blocks share, a popular id, NULL keys, vectors and numbers."""
    monkeypatch.setattr(bags, "_BLOCK_BYTES", block)
    rng, width = np.random.default_rng(3), 512
    vectors = {(t, i): rng.integers(-9, 9, width).tolist() for t in range(2) for i in range(20)}
    vectors[0, 3], vectors[0, 4][7] = None, None
    ids = [(f"s{rng.integers(30)}", int(rng.integers(2)), int(rng.integers(25))) for _ in range(400)]
    ids += [("hot", 0, int(i)) for i in rng.integers(0, 20, 500)] + [(None, 1, 5), (None, 1, 5), ("empty", 1, None)]
    ids += [(f"p{i}", 0, 1) for i in range(200)]
    want = {}
    for s, t, i in ids:
        total, missing = want.setdefault((s, t), [np.zeros(width), 0])
        if i is not None and (t, i) not in vectors:
            want[s, t][1] += 1
        elif i is not None and vectors[t, i] is not None:
            total += [0 if v is None else v for v in vectors[t, i]]
    table = spark.createDataFrame(
        [(t, i, v) for (t, i), v in vectors.items()], "table_id int, idx bigint, vector array<bigint>"
    ).withColumn("vector", F.col("vector").cast(f"array<{kind}>"))
    bagged = spark.createDataFrame(ids, "sample_id string, table_id int, idx bigint").repartition(7)
    if kind == "float":  # a column that is never NULL
        bagged = bagged.withColumn("table_id", F.coalesce("table_id", F.lit(0)))
    got = bags.embedding_bag_sum(bagged, table, width)
    assert got.schema["pooled"].dataType.elementType.simpleString() == ("bigint" if kind == "bigint" else "double")
    found = {(r.sample_id, r.table_id): (r.pooled, r.missing) for r in got.collect()}
    assert found == {k: (total.tolist(), missing) for k, (total, missing) in want.items()}


def test_embedding_bag_sum_of_nothing_and_too_much(spark):
    ids = spark.createDataFrame([(1, 0, 5), (1, 0, 5)], "sample_id bigint, table_id int, idx bigint")
    table = spark.createDataFrame([(0, 5, [1 << 62])], "table_id int, idx bigint, vector array<bigint>")
    with pytest.raises(Exception, match="leave 64 bits"):
        bags.embedding_bag_sum(ids, table, 1).collect()
    assert bags.embedding_bag_sum(ids.limit(0), table, 1).collect() == []
    (row,) = bags.embedding_bag_sum(ids, table.limit(0), 1).collect()
    assert (row.pooled, row.missing) == ([0], 2)


@pytest.mark.parametrize("count", [0, 1, 2, 5])
def test_pairwise_dot(spark, count):
    x = np.random.default_rng(count).integers(-5, 5, (count, 3)).astype(float)
    df = spark.createDataFrame([(x.tolist(),)], "v array<array<double>>")
    expected = [float(x[i] @ x[j]) for i in range(count) for j in range(i)]
    assert df.select(interaction.pairwise_dot(F.col("v"))).first()[0] == expected
    if count:
        assert scoring.interact(df, "v", "out").first()["out"] == expected


def layers(rng, *sizes):
    return [
        (rng.normal(0, 0.5, (o, i)), rng.normal(0, 0.5, o))
        for i, o in zip(sizes, sizes[1:], strict=False)
    ]


def forward(x, weights):
    for w, b in weights:
        x = np.maximum(w @ x + b, 0)
    return x


def test_score_model_against_brute_force(spark):
    rng = np.random.default_rng(7)
    bottom, top = layers(rng, 4, 6, 3), layers(rng, 3 + 3, 5, 1)
    dense = rng.random((40, 4))
    pooled = {(s, t): rng.random(3) for s in range(40) for t in range(2) if (s, t) != (11, 1)}
    samples = spark.createDataFrame(
        [(s, d.tolist()) for s, d in enumerate(dense)], "sample_id bigint, dense array<double>"
    )
    table = spark.createDataFrame(
        [(s, t, v.tolist()) for (s, t), v in pooled.items()],
        "sample_id bigint, table_id int, pooled array<double>",
    )
    got = {
        r["sample_id"]: r["score"]
        for r in scoring.score_model(samples, table, 2, bottom, top).collect()
    }
    assert len(got) == 40
    for s in range(40):
        b = forward(dense[s], bottom)
        v = [b, *[pooled.get((s, t), np.zeros(3)) for t in range(2)]]
        dots = [v[i] @ v[j] for i in range(3) for j in range(i)]
        np.testing.assert_allclose(got[s], forward(np.concatenate([b, dots]), top), rtol=1e-12)


@pytest.mark.parametrize("rows", [[[1.0] * 3, [2.0] * 5], [[1.0] * 3], [[]]])
def test_vectors_of_another_width_are_refused(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "x array<double>").coalesce(1)
    with pytest.raises(Exception, match="x has .* instead of 4"):
        scoring.score_mlp(df, "x", [(np.ones((2, 4)), np.ones(2))]).collect()


def test_a_null_vector_has_no_score(spark):
    df = spark.createDataFrame(
        [(0, None), (1, [1.0, 2.0]), (2, None), (3, [3.0, 4.0])], "id int, x array<double>"
    ).coalesce(1)
    got = scoring.score_mlp(df, "x", [(np.ones((1, 2)), np.ones(1))]).collect()
    assert [tuple(r)[::2] for r in got] == [(0, None), (1, [4.0]), (2, None), (3, [8.0])]


def test_ragged_interactions_are_refused(spark):
    df = spark.createDataFrame([([[1.0], [2.0]],), ([[1.0]],)], "v array<array<double>>").coalesce(1)
    with pytest.raises(Exception, match="v has 1 to 2 entries"):
        scoring.interact(df, "v", "out").collect()


@pytest.mark.parametrize("wrong", [(0, 2), (0, -1), (0, None), (0, 1)])
def test_unknown_and_repeated_tables_are_refused(spark, wrong):
    rng = np.random.default_rng(1)
    samples = spark.createDataFrame([(0, [1.0])], "sample_id bigint, dense array<double>")
    rows = [(0, 0, [1.0, 2.0]), (0, 1, [1.0, 2.0])]
    schema = "sample_id bigint, table_id int, pooled array<double>"
    model = 2, layers(rng, 1, 2), layers(rng, 5, 1)
    assert scoring.score_model(samples, spark.createDataFrame(rows, schema), *model).count() == 1
    more = spark.createDataFrame([*rows, (*wrong, [3.0, 4.0])], schema)
    with pytest.raises(Exception, match="beyond 2 or twice"):
        scoring.score_model(samples, more, *model).collect()


def test_many_tables(spark):
    samples = spark.createDataFrame([(0, [1.0])], "sample_id bigint, dense array<double>")
    pooled = spark.createDataFrame(
        [(0, t, [1.0]) for t in range(130)], "sample_id bigint, table_id int, pooled array<double>"
    )
    bottom, pairs = [(np.ones((1, 1)), np.zeros(1))], 131 * 130 // 2
    top = [(np.ones((1, 1 + pairs)), np.zeros(1))]
    assert scoring.score_model(samples, pooled, 130, bottom, top).first()["score"] == [1.0 + pairs]


def test_rows_without_a_time_are_a_stage(spark, staging):
    df = spark.createDataFrame(
        [(1, "2024-01-01"), (2, None), (3, "2024-01-02"), (4, "2024-01-02")], "id int, at string"
    ).withColumn("at", F.to_timestamp("at"))
    got = {r["id"]: r["stage"] for r in split.temporal_split(df, "at", "id", staging).collect()}
    assert got == {1: "train", 2: "undated", 3: "val", 4: "test"}
    empty = split.temporal_split(df.filter("id = 2"), "at", "id", staging)
    assert [r["stage"] for r in empty.collect()] == ["undated"]


def test_layer_shapes_are_checked(spark):
    df = spark.createDataFrame([([1.0],)], "x array<double>")
    with pytest.raises(ValueError, match="input width"):
        scoring.score_mlp(df, "x", [(np.ones((2, 1)), np.ones(2)), (np.ones((1, 3)), np.ones(1))])


@pytest.mark.parametrize("last", [0, 1, 7, 1001])
def test_temporal_split(spark, staging, last):
    """Exact halves of the last day, with many equal times."""
    rows = [(n, f"2024-01-0{1 + n % 2} 10:00:00") for n in range(60)]
    rows += [(100 + n, f"2024-01-05 0{n % 3}:00:00") for n in range(last)]
    df = spark.createDataFrame(rows, "id bigint, at string").withColumn("at", F.to_timestamp("at"))
    got = {r["id"]: r["stage"] for r in split.temporal_split(df, "at", "id", staging).collect()}
    assert len(got) == len(rows)
    day = max(at[:10] for _, at in rows)
    final = [n for at, n in sorted((at, n) for n, at in rows if at.startswith(day))]
    half = len(final) // 2
    assert {n for n, s in got.items() if s == "train"} == {n for n, at in rows if at[:10] != day}
    assert {n for n, s in got.items() if s == "val"} == set(final[:half])
    assert {n for n, s in got.items() if s == "test"} == set(final[half:])
