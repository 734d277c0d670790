"""Phrase collocations from a weighted de Bruijn graph.

Nodes are pairs of words, edges the three-word phrases that lead from the pair of
their first two words to that of their last two, weighted by how often they occur.
Every position of a piece gives one edge, padded behind the last word; the padded
ones correct for the end of the piece. Then

* a pair occurs as often as its node has flow: all edges out of it and its ends,
* a word occurs as often as the pairs that start with it and its own ends,
* a chain of nodes with one way in and one way out, all of the same weight, is
  compacted to one path, whose inner pairs need no look-up: they have its weight.

Only edges with the minimum count are compacted, as lighter ones can neither be
phrases nor absorb any; they count in the flows like all others.

Words are numbers: a frequent one is a short code, any other a hash of 63 bits,
which is checked for collisions over all words and made anew with another seed if
there is one. Codes only make rows small: at most SHORT_WORDS words have one, and
their list is what is sent to the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.llm.common import staged

BITS = 21
#: Words with a short code, at most: eight bytes each are sent to every task.
SHORT_WORDS = 1 << 18
#: Of a text longer than this, so many bytes are taken apart at a time.
BLOCK = 1 << 22
#: Words that are taken apart at a time, and positions that are counted together.
CHUNK, COUNTED = 1 << 18, 1 << 21
#: A word is hot from this share of all words on; a pair is no hotter than its words.
HOT_WORDS, SALTS = 1000, 64

_MASK = (1 << BITS) - 1
_END = b"\xff"  # in no UTF-8 text
_LOWER = bytes(
    0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_GAP = re.compile(rb"[\x20\x09\xff]")
_NEXT = re.compile(rb"[\x20\x09]*([^\x20\x09\xff]+)")


def _tokens(text: bytes, block: int) -> Iterator[tuple[list[bytes], int]]:
    """Words and piece ends of a text in lists that end with a piece end.

    With each the number of words before that which only follow the list's own.
    """
    text, at = text.translate(_LOWER), 0
    while at < len(text):
        gap = _GAP.search(text, at + block) if len(text) - at > block else None
        stop = gap.start() if gap else len(text)
        tokens = text[at:stop].replace(_END, b" \xff ").split()
        ahead, place = 0, stop
        while ahead < 2 and (word := _NEXT.match(text, place)):
            tokens.append(word[1])
            ahead, place = ahead + 1, word.end()
        tokens.append(_END)
        yield tokens, ahead
        at = stop


def _chunks(batches: Iterator, block: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, list[bytes]]]:
    """Tokens of several texts, the language number of each, which are no own ones, and the languages."""
    import pyarrow as pa

    tokens, sizes, of, ahead, names = [], [], [], [], {}

    def taken():
        other = np.zeros(len(tokens), bool)
        for end, n in ahead:
            other[end - n - 1 : end - 1] = True
        return tokens, np.repeat(np.array(of, np.int64), sizes), other, list(names)

    for batch in batches:
        texts, langs = (batch.column(i).cast(pa.binary()) for i in (0, 1))
        for text, lang in zip(texts, langs):
            text, lang = text.as_py(), lang.as_py()
            for found, n in _tokens(text or b"", block):
                number = names.setdefault(b"und" if lang is None else lang, len(names))
                tokens += found
                sizes.append(len(found))
                of.append(number)
                if n:
                    ahead.append((len(tokens), n))
                if len(tokens) >= CHUNK:
                    yield taken()
                    tokens, sizes, of, ahead, names = [], [], [], [], {}
    if tokens:
        yield taken()


def _distinct(tokens: list[bytes], langs: np.ndarray, names: list[bytes], seed: int):
    """The different (language, word) of a chunk, their hashes, and which one each token is.

    Hashes are negative; that of a piece end is 0.
    """
    import pyarrow as pa
    import xxhash

    encoded = pa.array(tokens, pa.binary()).dictionary_encode()
    words = encoded.dictionary.to_pylist()
    pair = langs * len(words) + encoded.indices.to_numpy()
    distinct, which = np.unique(pair, return_inverse=True)
    prefixes = [len(n).to_bytes(4, "little") + n for n in names]
    of = [(int(p) // len(words), words[int(p) % len(words)]) for p in distinct]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (0 if w == _END else digest(prefixes[n] + w, seed) | 1 << 63 for n, w in of), np.uint64, len(of)
    )
    return of, hashes.view(np.int64), which


def word_counts(documents: DataFrame, text: str = "text", lang: str = "lang", block: int = BLOCK) -> tuple[DataFrame, int]:
    """``hash``, ``lang``, ``word``, ``n`` of all words, and the seed with which no two have one hash."""

    def counting(seed: int):
        def count(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for tokens, langs, other, names in _chunks(batches, block):
                of, hashes, which = _distinct(tokens, langs, names, seed)
                n = np.bincount(which[~other], minlength=len(of))
                keep = np.flatnonzero((hashes != 0) & (n > 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[keep]),
                        pa.array([names[of[i][0]].decode() for i in keep], pa.string()),
                        pa.array([of[i][1].decode() for i in keep], pa.string()),
                        pa.array(n[keep].astype(np.int64)),
                    ],
                    names=["hash", "lang", "word", "n"],
                )

        return count

    texts = documents.select(F.col(text).cast("string"), F.col(lang).cast("string"))
    for seed in range(100):
        rows = texts.mapInArrow(counting(seed), "hash bigint, lang string, word string, n bigint")
        words = staged(rows.groupBy("hash", "lang", "word").agg(F.sum("n").alias("n")), "collocation-words")
        if not words.groupBy("hash").count().filter("count > 1").limit(1).count():
            return words, seed
    raise ValueError("two words have the same hash under every seed")


def _short_words(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent words, sorted, and which of them are hot.

    These are all that occur 2**k times, with the least k that gives no more than ``most``.
    """
    power = F.floor(F.log2("n")).cast("int").alias("k")
    sizes = words.groupBy(power).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()  # 64 rows at most
    k, room = 64, most
    for row in sorted(sizes, reverse=True):
        room -= row["words"]
        if room < 0:
            break
        k = row["k"]
    total = sum(row["n"] for row in sizes)
    chosen = words.filter(power >= k).select("hash", (F.col("n") * HOT_WORDS >= F.lit(total)).alias("hot")).toArrow()
    chosen = chosen.sort_by("hash")
    return chosen["hash"].to_numpy(), chosen["hot"].to_numpy()


def _codes(hashes: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Short codes from 1 where there are, hashes elsewhere."""
    if not len(short):
        return hashes
    at = np.minimum(np.searchsorted(short, hashes), len(short) - 1)
    return np.where(short[at] == hashes, at + 1, hashes)


def _summed(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray):
    """The different edges and how often each occurs."""
    short = (w1 > 0) & (w2 >= 0) & (w3 >= 0)
    key, n = np.unique(w1[short] << 2 * BITS | w2[short] << BITS | w3[short], return_counts=True)
    rest = np.stack([w1[~short], w2[~short], w3[~short]])
    rest = rest[:, np.lexsort(rest)]
    first = np.flatnonzero(np.concatenate([[True], (rest[:, 1:] != rest[:, :-1]).any(axis=0)])[: rest.shape[1]])
    kept = rest[:, first]
    both = (key >> 2 * BITS, key >> BITS & _MASK, key & _MASK)
    return [np.concatenate(x) for x in zip(both, kept)] + [
        np.concatenate([n, np.diff(np.append(first, rest.shape[1]))])
    ]


def _merged(batches: Iterator, min_count: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Node flows and heavy edges from sorted edges: x, y, salt, and z (-1 for a node) and n.

    Between batches only the last edge and the flow of its node so far are kept.
    """

    def runs(*columns: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], *[np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]]))

    edge = [np.empty(0, np.int64)] * 5  # x, y, salt, z, n
    node = [np.empty(0, np.int64)] * 4  # x, y, salt, flow

    def out(rows: list[np.ndarray], ended: list[np.ndarray]):
        heavy = (rows[4] >= min_count) & (rows[3] != 0)
        marked = [*ended[:3], np.full(len(ended[0]), -1, np.int64), ended[3]]
        return tuple(np.concatenate([r[heavy], m]) for r, m in zip(rows, marked))

    for batch in batches:
        rows = [np.concatenate([e, c.to_numpy().astype(np.int64)]) for e, c in zip(edge, batch.columns)]
        if not len(rows[0]):
            continue
        first = runs(*rows[:4])
        rows = [c[first] for c in rows[:4]] + [np.add.reduceat(rows[4], first)]
        edge, rows = [c[-1:] for c in rows], [c[:-1] for c in rows]
        if not len(rows[0]):
            continue
        nodes = [np.concatenate([n, c]) for n, c in zip(node, [*rows[:3], rows[4]])]
        first = runs(*nodes[:3])
        nodes = [c[first] for c in nodes[:3]] + [np.add.reduceat(nodes[3], first)]
        node, nodes = [c[-1:] for c in nodes], [c[:-1] for c in nodes]
        yield out(rows, nodes)
    if len(edge[0]):
        nodes = [np.concatenate([n, c]) for n, c in zip(node, [*edge[:3], edge[4]])]
        first = runs(*nodes[:3])
        nodes = [c[first] for c in nodes[:3]] + [np.add.reduceat(nodes[3], first)]
        yield out(edge, nodes)


def graph(
    documents: DataFrame, words: DataFrame, seed: int, text: str = "text", lang: str = "lang",
    min_count: int = 10, block: int = BLOCK, short_words: int = SHORT_WORDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph of all texts: nodes, the edges of at least ``min_count``, and words.

    Nodes are ``w1``, ``w2`` (0: the end of the piece), ``flow``; edges ``w1``,
    ``w2``, ``w3``, ``n``; words ``id``, ``lang``, ``word``, ``f`` (of at least
    ``min_count``, from the flow). Nodes are in one partition each, but those of
    two hot words, which are spread by their third.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(_short_words(words, short_words))

    def edges_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        short, hot = sent.value
        hot = np.concatenate([[False], hot])
        held, size = [], 0

        def counted():
            w1, w2, w3, n = _summed(*(np.concatenate(x) for x in zip(*held)))
            small = (w1 > 0) & (w2 >= 0)
            x, y = np.where(small, w1 << BITS | w2, w1), np.where(small, 0, w2)
            spread = hot[np.where(small, w1, 0)] & hot[np.where(small, w2, 0)]
            salt = np.where(spread, 1 + w3 % SALTS, 0)
            for at in range(0, len(n), 1 << 17):
                part = slice(at, at + (1 << 17))
                arrays = [pa.array(a[part].astype(t)) for a, t in ((x, "i8"), (y, "i8"), (salt, "i4"), (w3, "i8"), (n, "i8"))]
                yield pa.RecordBatch.from_arrays(arrays, names=["x", "y", "salt", "z", "n"])

        for tokens, langs, other, names in _chunks(batches, block):
            _, hashes, which = _distinct(tokens, langs, names, seed)
            ids = np.append(_codes(hashes, short)[which], [0, 0])
            at = np.flatnonzero((ids[:-2] != 0) & ~other)
            w2 = ids[at + 1]
            held.append((ids[at], w2, np.where(w2 != 0, ids[at + 2], 0)))
            size += len(at)
            if size >= COUNTED:
                yield from counted()
                held, size = [], 0
        if held:
            yield from counted()

    def nodes_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for x, y, salt, z, n in _merged(batches, min_count):
            packed = (x >= 0) & (y == 0)
            arrays = [
                pa.array(np.where(packed, x >> BITS, x)),
                pa.array(np.where(packed, x & _MASK, y)),
                pa.array(z, mask=z == -1),
                pa.array(n),
                pa.array(salt > 0),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["w1", "w2", "w3", "n", "spread"])

    texts = documents.select(F.col(text).cast("string"), F.col(lang).cast("string"))
    edges = texts.mapInArrow(edges_of, "x bigint, y bigint, salt int, z bigint, n bigint")
    edges = edges.repartition("x", "y", "salt").sortWithinPartitions("x", "y", "salt", "z")
    merged = staged(
        edges.mapInArrow(nodes_of, "w1 bigint, w2 bigint, w3 bigint, n bigint, spread boolean"), "collocation-graph"
    )
    nodes = merged.filter("w3 IS NULL").withColumnRenamed("n", "flow")
    spread = nodes.filter("spread").groupBy("w1", "w2").agg(F.sum("flow").alias("flow"))
    flows = nodes.filter("NOT spread").select("w1", "w2", "flow").unionByName(spread)
    heavy_edges = merged.filter("w3 IS NOT NULL").select("w1", "w2", "w3", "n")

    @F.pandas_udf("bigint")
    def code(hashes: pd.Series) -> pd.Series:
        return pd.Series(_codes(hashes.to_numpy(), sent.value[0]))

    flow = flows.groupBy(F.col("w1").alias("id")).agg(F.sum("flow").alias("f")).filter(F.col("f") >= min_count)
    known = words.filter(F.col("n") >= min_count).select(code("hash").alias("id"), "lang", "word")
    return flows, heavy_edges, staged(known.join(flow, "id"), "collocation-known")


def paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Maximal unary paths: ``words`` (their numbers in order) and ``weight``.

    A node is inside a path if it has one edge in, one edge out, and both have its
    whole flow. Every edge is in exactly one path. Each edge points at the one
    before it, and pointers are doubled until all are at the head of their path.
    There are no circles: a circle of such nodes would be a piece without a start.
    """
    ends = edges.select("w1", "w2", F.col("n").alias("out_n"), F.lit(None).cast("bigint").alias("in_n"), F.lit(None).cast("bigint").alias("before")).unionByName(
        edges.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), F.lit(None).cast("bigint").alias("out_n"), F.col("n").alias("in_n"), F.col("w1").alias("before"))
    )
    # a node with one edge in and one out has the sums, the least and the first of one
    sides = ends.groupBy("w1", "w2").agg(
        F.count("out_n").alias("outs"), F.count("in_n").alias("ins"), F.max("out_n").alias("out_n"),
        F.max("in_n").alias("in_n"), F.max("before").alias("before"),
    ).filter("outs = 1 AND ins = 1 AND out_n = in_n")
    inner = sides.join(nodes, ["w1", "w2"]).filter("flow = in_n").select("w1", "w2", "before")
    linked = edges.join(inner, ["w1", "w2"], "left")
    # the edge before (w1, w2, w3) is (before, w1, w2)
    pointers = staged(
        linked.select(
            "w1", "w2", "w3", "n",
            F.when(F.col("before").isNull(), F.struct("w1", "w2", "w3"))
            .otherwise(F.struct(F.col("before").alias("w1"), F.col("w1").alias("w2"), F.col("w2").alias("w3")))
            .alias("head"),
            F.col("before").isNotNull().cast("bigint").alias("steps"),
        ),
        "collocation-pointers",
    )
    while True:
        # only edges that point at one which itself points on are still moving
        on = pointers.filter("steps > 0").select(
            F.struct("w1", "w2", "w3").alias("head"), F.col("head").alias("further"), F.col("steps").alias("more")
        )
        moved = staged(pointers.join(on, "head", "left"), "collocation-pointers")
        moving = moved.filter("further IS NOT NULL").limit(1).count()
        if not moving:
            break
        pointers = moved.select(
            "w1", "w2", "w3", "n", F.coalesce("further", "head").alias("head"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
        )
    words = F.sort_array(F.collect_list(F.struct("steps", "w3")))
    return pointers.groupBy("head").agg(words.alias("row"), F.max("n").alias("weight")).select(
        F.concat(F.array("head.w1", "head.w2"), F.col("row.w3")).alias("words"), "weight"
    )


def _score(a: str, l: str, r: str) -> Column:
    exact = lambda c: f"cast({c} AS decimal(15, 0))"
    return F.expr(f"(1000000 * {exact(a)} * {exact(a)}) div ({exact(l)} * {exact(r)})")


def collocations(
    documents: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 10, top: int = 2000,
    absorbed: int = 50, block: int = BLOCK, short_words: int = SHORT_WORDS,
) -> DataFrame:
    """The first ``top`` phrases of two or three words of each language.

    A-Z count as a-z, pieces end at ``.,;:!?`` and line ends, words are apart by
    spaces and tabs. A phrase needs ``min_count`` occurrences; a pair inside a
    phrase of three that occurs ``absorbed`` percent as often as itself is left
    out. The score is floor(10^6 a^2 / (l r)) for the cut in two parts, with l and
    r occurrences, where it is lowest, the first of several such. Ties are in the
    order of a (falling), then of the phrase in bytes.

    Returns ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` (all words of
    the language), ``score``. A null text has no words, a null language is ``und``;
    other columns do not matter. Equal rows all count. A language without phrases
    has no row. From 10^15 occurrences on it fails rather than round.
    """
    documents = documents.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    words, seed = word_counts(documents, block=block)
    nodes, edges, known = graph(documents, words, seed, min_count=min_count, block=block, short_words=short_words)
    heavy = staged(nodes.filter((F.col("flow") >= min_count) & (F.col("w2") != 0)), "collocation-flows")
    found = staged(paths(edges, heavy), "collocation-paths")

    # flows at both ends of a path; inside it is the weight
    size = F.size("words")
    at = lambda i: F.element_at("words", i)
    head = heavy.select(F.col("w1").alias("h1"), F.col("w2").alias("h2"), F.col("flow").alias("head_flow"))
    tail = heavy.select(F.col("w1").alias("t1"), F.col("w2").alias("t2"), F.col("flow").alias("tail_flow"))
    ended = (
        found.withColumns({"h1": at(1), "h2": at(2), "t1": at(-2), "t2": at(-1)})
        .join(head, ["h1", "h2"]).join(tail, ["t1", "t2"])
    )
    # each edge of a path with its place from 1 to size - 2
    threes = ended.select("*", F.explode(F.sequence(F.lit(1), size - 2)).alias("i")).select(
        F.expr("words[i - 1]").alias("w1"), F.expr("words[i]").alias("w2"), F.expr("words[i + 1]").alias("w3"),
        F.col("weight").alias("a"),
        F.expr("if(i = 1, head_flow, weight)").alias("left2"),
        F.expr("if(i = size(words) - 2, tail_flow, weight)").alias("right2"),
    )
    inside = (
        found.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("i"))
        .groupBy(F.expr("words[i - 1]").alias("w1"), F.expr("words[i]").alias("w2"))
        .agg(F.max("weight").alias("most"))
    )
    twos = heavy.join(inside, ["w1", "w2"], "left").filter(
        F.col("most").isNull() | (100 * F.col("most") < absorbed * F.col("flow"))
    ).select("w1", "w2", F.lit(None).cast("bigint").alias("w3"), F.col("flow").alias("a"),
             F.lit(None).cast("bigint").alias("left2"), F.lit(None).cast("bigint").alias("right2"))

    def name(i: int, *more: str) -> DataFrame:
        return known.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"word{i}"), F.col("f").alias(f"f{i}"), *more)

    named = threes.unionByName(twos).join(name(1, "lang"), "w1").join(name(2), "w2").join(name(3), "w3", "left")
    cut = lambda l, r, k: F.struct(
        _score("a", l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r")
    )
    scored = named.select(
        "lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a",
        F.when(F.col("w3").isNull(), cut("f1", "f2", 1))
        .otherwise(F.least(cut("f1", "right2", 1), cut("left2", "f3", 2)))
        .alias("cut"),
    ).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = scored.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
