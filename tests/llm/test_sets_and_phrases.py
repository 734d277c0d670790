"""Collocations, whitening and the chosen-path join, against plain Python and numpy."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tracewise.llm import chosen_path, collocations, whitening


# Collocations.


def plain_pieces(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def plain_counts(rows):
    counts = {}
    for text, lang in rows:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for w in plain_pieces(text):
            f.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    return counts


def plain_collocations(rows, min_count=10, top=2000, absorbed=50):
    found = []
    for lang, f in plain_counts(rows).items():
        n = sum(a for p, a in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        gone = {
            p for q, b in candidates.items() if len(q) == 3 for p in (q[:2], q[1:])
            if 100 * b >= absorbed * candidates[p]
        }
        ranked = []
        for p, a in candidates.items():
            if p not in gone:
                cuts = [(p[:k], p[k:], k) for k in range(1, len(p))]
                score, _, l, r = min((10**6 * a * a // (f[x] * f[y]), k, f[x], f[y]) for x, y, k in cuts)
                ranked.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (score, a, p, l, r) in enumerate(sorted(ranked)[:top]):
            found.append((lang, i + 1, p.decode(), -a, l, r, n, -score))
    return sorted(found)


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(1)
    vocabulary = "Alpha beta gamma DELTA eps zeta été x y".split()
    marks = ["", "", ".", "\n", ",\t", "\x0b"]
    rows = [
        (" ".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.randint(0, 60))),
         rng.choice(["en", "de", None]))
        for _ in range(200)
    ]
    rows += [("one two three four five six seven. eight nine ten eleven", "en")] * 15
    return rows + [(None, "en"), ("", None), (" \t .,;", ""), ("a" * 50_000 + " b c", "en")]


@pytest.mark.parametrize("more", [{}, {"block": 40}, {"short_words": 5}, {"short_words": 0, "block": 7}])
def test_collocations_equal_plain_python(spark, phrases, more):
    """Words taken apart in blocks of any size, and with or without short codes."""
    df = spark.createDataFrame(phrases, "text string, lang string")
    got = collocations.collocations(df, **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(phrases)


def test_collocations_of_the_first_few_and_of_every_count(spark, phrases):
    df = spark.createDataFrame(phrases[:60], "text string, lang string")
    got = collocations.collocations(df, min_count=2, top=7, absorbed=80).collect()
    assert sorted(map(tuple, got)) == plain_collocations(phrases[:60], 2, 7, 80)


def test_flows_and_paths_of_the_graph(spark):
    rows = [("a b c d e f", "en")] * 3 + [("x b c d e y", "en")] * 2 + [("m n o p", "en")] * 4 + [("n o", "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    words, seed = collocations.word_counts(df)
    assert {(r.word, r.n) for r in words.collect()} == {
        (p[0], n) for p, n in plain_counts(rows)["en"].items() if len(p) == 1
    }
    nodes, edges, known = collocations.graph(df, words, seed, min_count=2)
    name = {r.id: r.word for r in known.collect()}
    flows = {tuple(name[w] for w in (r.w1, r.w2) if w): r.flow for r in nodes.collect()}
    f = plain_counts(rows)["en"]
    assert {p: n for p, n in flows.items() if len(p) == 2} == {p: n for p, n in f.items() if len(p) == 2}
    assert {r.word: r.f for r in known.collect()} == {p[0]: n for p, n in f.items() if len(p) == 1}
    found = {(" ".join(name[w] for w in r.words), r.weight) for r in collocations.paths(edges, nodes).collect()}
    # b c and c d have two ways in; d e has two ways out; n o starts a piece once more
    assert found == {("a b c", 3), ("x b c", 2), ("b c d e", 5), ("d e f", 3), ("d e y", 2), ("m n o", 4), ("n o p", 4)}


def test_a_long_piece_is_one_path(spark):
    text = " ".join(f"w{i}" for i in range(700))
    df = spark.createDataFrame([(text, "en")] * 2, "text string, lang string")
    words, seed = collocations.word_counts(df)
    nodes, edges, _ = collocations.graph(df, words, seed, min_count=2)
    (path,) = collocations.paths(edges, nodes).collect()
    assert len(path.words) == 700 and path.weight == 2


def test_collocations_of_nothing_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).collect() == []
    rows = [("big deal", "en", i, i) for i in range(12)]
    df = spark.createDataFrame(rows, "body string, lang string, n int, W1 int")
    (row,) = collocations.collocations(df, text="body").collect()
    assert tuple(row) == ("en", 1, "big deal", 12, 12, 12, 24, 1000000)


# Whitening.


def whitened(spark, vectors, most=4):
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    return whitening.whiten(df, most=most).toPandas().sort_values(["component", "vec_id"])


def plain_whitening(vectors, k):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    different = np.unique(x, axis=0)
    n, sums = len(different), different.sum(axis=0)
    centred = different - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    scores = (x - sums / n) @ axes[:, :k] / np.sqrt(values[:k])
    return n, np.square(n * x - sums).sum(axis=1), scores, values / values.sum()


@pytest.mark.parametrize("kind", ["random", "repeated", "scales", "dependent"])
def test_whitening_equals_an_eigen_decomposition(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    if kind == "repeated":
        x = np.concatenate([x, x[:100], x[:1].repeat(500, axis=0)])
    if kind == "scales":
        x = x * [1e3, 1e2, 10, 1, 0.1, 1e4]
    if kind == "dependent":  # whole numbers, so that it holds after rounding down
        x = np.floor(rng.normal(size=(300, 3)) * 9)
        x = np.concatenate([x, x @ [[1, 2, 0], [0, 1, 1], [3, 0, 1]], np.ones((300, 1))], axis=1)
    k = 3 if kind == "dependent" else 6
    n, deviation, scores, explained = plain_whitening(x, k)
    got = whitened(spark, x.tolist(), most=6)
    assert set(got["component"]) == set(range(1, k + 1)) and set(got["n"]) == {n}
    for c in range(k):
        rows = got[got["component"] == c + 1]
        assert [int(d) for d in rows["deviation"]] == deviation.tolist()
        sign = np.sign(rows["whitened"].to_numpy() @ scores[:, c])
        np.testing.assert_allclose(rows["whitened"], sign * scores[:, c], atol=1e-8)
        np.testing.assert_allclose(rows["explained"], explained[c], rtol=1e-8)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9


def test_passes_make_badly_conditioned_rows_orthonormal(spark):
    """Columns that differ from each other by a millionth of their size."""
    rng = np.random.default_rng(5)
    base = np.floor(rng.normal(size=(400, 1)) * 1e8)
    x = (base + np.floor(rng.normal(size=(400, 4)) * 100)) / 256
    got = whitened(spark, x.tolist())
    _, _, scores, explained = plain_whitening(x, 1)
    assert set(got["component"]) >= {1, 2, 3} and got["identity_error"].max() < 1e-4
    first = got[got["component"] == 1]["whitened"].to_numpy()
    np.testing.assert_allclose(np.abs(first), np.abs(scores[:, 0]), atol=1e-6)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, nan]), (2, [1.0, 2.0]), (None, [3.0, inf]), (None, [5.0, 6.0]), (3, [None, 1.0]), (4, []),
            (5, None), (6, [1.0, 2.0]), (7, [1.0]), (8, [-inf, 0.0])]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id bigint, embedding array<double>, x int, N string")
    got = whitening.whiten(df, most=4).collect()
    assert sorted((r.vec_id is None, r.vec_id, r.component, r.n, int(r.deviation)) for r in got if r.vec_id) == [
        (False, 2, 1, 2, 2 * 1024**2), (False, 6, 1, 2, 2 * 1024**2)
    ]
    assert [r.whitened for r in got if r.vec_id is None] == pytest.approx([1.0])


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [3.0]), (2, [3.0])], [(1, [])]])
def test_whitening_of_what_does_not_vary(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = whitening.whiten(df)
    assert got.collect() == []
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_64_bits(spark):
    rows = [[float(i * 10**9), float(i)] for i in range(40)]
    got = whitened(spark, rows, most=1)
    x = [[int(256 * c) for c in r] for r in rows]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((40 * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    assert max(want) > 1 << 63 and [int(d) for d in got["deviation"]] == want


# Chosen-path join.


def plain_sets(rows, k=2):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = set() if not w else {tuple(w)} if len(w) < k else set(zip(*(w[j:] for j in range(k))))
    return sets


def plain_near_duplicates(rows, k=2, percent=80):
    sets = plain_sets(rows, k)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders.get(x, ()))
        for x in s:
            holders.setdefault(x, []).append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets.items())


@pytest.fixture(scope="module")
def copied():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(200)]
    for _ in range(20):
        base = rng.choices(vocabulary, k=60)
        for _ in range(rng.randint(1, 12)):
            text = list(base)
            for _ in range(rng.randint(0, 8)):
                text[rng.randrange(60)] = rng.choice(vocabulary)
            texts.append(" ".join(text))
    texts += [None, "", " \t\n", "one", "ONE", "one two", "Été", "été", texts[-1].upper(), "a " * 3000]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("more", [{}, {"small": 30}, {"percent": 70, "shingle": 3}])
def test_components_equal_brute_force(spark, copied, more):
    df = spark.createDataFrame(copied, "doc_id bigint, text string")
    got = sorted(map(tuple, chosen_path.near_duplicates(df, **more).collect()))
    assert got == plain_near_duplicates(copied, more.get("shingle", 2), more.get("percent", 80))


def test_a_large_loose_group_branches(spark):
    """Copies with few to many changes: larger nodes than are compared, and not one class."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base, rows = rng.choices(vocabulary, k=100), []
    for i in range(700):
        text = list(base)
        for _ in range(rng.randint(0, 14)):
            text[rng.randrange(100)] = rng.choice(vocabulary)
        rows.append((i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, chosen_path.near_duplicates(df).collect())) == plain_near_duplicates(rows)


def test_pairs_of_a_crowd_do_not_grow_with_its_square(spark, monkeypatch):
    """Copies with changes that link about half of them to the text they come from, and few to each other."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    base = rng.choices(vocabulary, k=100)
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        text = list(base)
        for at in rng.sample(range(100), rng.randint(4, 9)):
            text[at] = rng.choice(vocabulary)
        rows.append((i, " ".join(text)))
    staged, pairs = chosen_path.staged, []

    def counted(df, name):
        table = staged(df, name)
        if name.endswith("-pairs"):
            pairs.append(table.count())
        return table

    monkeypatch.setattr(chosen_path, "staged", counted)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, chosen_path.near_duplicates(df).collect())) == plain_near_duplicates(rows)
    assert sum(pairs) < 20 * len(rows)


def test_trees_follow_from_the_recall():
    assert chosen_path.trees_for(0.5, 0.8, 1) == 1
    assert chosen_path.trees_for(0.9999, 0.8, 4) == 11
    assert chosen_path.trees_for(0.9999, 0.8, 8) > 11


def test_long_texts_have_the_same_set_in_any_blocks(spark, monkeypatch):
    text = " ".join(f"w{i % 997} v{i % 89}" for i in range(20_000))
    (whole,) = [s for sets in chosen_path._sets([Scalar(text)], 2) for s in sets]
    monkeypatch.setattr(chosen_path, "_BLOCK", 1000)
    (cut,) = [s for sets in chosen_path._sets([Scalar(text)], 2) for s in sets]
    assert len(whole) == len(plain_sets([(0, text)])[0]) and (whole == cut).all()


class Scalar:
    def __init__(self, text):
        self.text = text

    def as_py(self):
        return self.text.encode()


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    rows = [(None, "a b c", 1, 1), (5, "a b c", 2, 2), (5, "a b c", 2, 2), (None, None, 3, 3), (9, "x", 4, 4), (8, "", 5, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row int, COMPONENT_ID int")
    got = chosen_path.near_duplicates(df).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
        (None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 0, None, False), (9, 1, 9, True), (8, 0, 8, True),
    ]))
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert chosen_path.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("edges_of_a_block", [1 << 18, 40])
def test_components_by_blocks(spark, monkeypatch, edges_of_a_block):
    from tracewise.llm import common

    monkeypatch.setattr(common, "BLOCK_EDGES", edges_of_a_block)
    chain = [(i + 1, i) if i % 3 else (i, i + 1) for i in range(60)]
    edges = chain + chain[:5] + [(500 + i, 1000) for i in range(40)] + [(7, 7)]
    table = common.staged(spark.createDataFrame(edges, "u bigint, v bigint").repartition(6), "t")
    got = [(r.node, r.component) for r in common.block_components(table, "t").collect()]
    assert dict(got) == {**dict.fromkeys(range(61), 0), **{500 + i: 500 for i in range(40)}, 1000: 500}
    assert len(got) == len(dict(got))
    assert common.block_components(table.limit(0), "t").count() == 0
