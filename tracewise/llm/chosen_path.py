"""Near-duplicates by a chosen-path set similarity join.

Every document has a set of shingles, every set its least elements under
COORDINATES random orders. A tree starts with all sets in its root. A node chooses
one or two of the orders by its own name, 1/similarity on average, and a set goes on
to the child that its least element in a chosen order names. Two sets go the same
way with a probability equal to their similarity: similar ones stay together in
some branch of a tree with a probability that hardly falls with its depth, while
others thin out faster than branches add to them. Sets in small nodes are all
compared; large nodes branch on. Independent trees are repeated until the wanted
recall is reached.

Equal sets are one. What is asked for are classes, so sets known to be linked by
others are not compared: first all sets of a node with one of them, its leader, and
the links found so give the classes known from there on. A node with one class is
done, which is what becomes of groups of any number of near copies.

A group of texts a little less alike than is asked for is no class, and nearly all of
its pairs look like links. Sets that many others of a node are near to form a crowd:
trees take it for one class, and its sets are compared with one another by the
elements that the crowd has least of, of which linked sets share an early one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.llm.common import block_components, join_keyed, staged
from tracewise.llm.text import word_blocks

COORDINATES = 64
#: A node is compared as it is if its pairs of a row outside its largest class and any row are no more
#: than the square of this; others branch.
SMALL_NODE = 512
#: Share of the links of exactly the least similarity that trees find which are DEPTH levels deep.
RECALL, DEPTH = 0.9999, 4
#: Two bits of each least element are compared before the sets; of the 128 pairs of bits so many may
#: differ. Of links with exactly a similarity of 0.8 about one in 10^5 has more.
DIFFERENT_BITS = 32
#: Levels that a set goes down at a time after the first: nodes on the way are not looked at.
STEP = 3
#: Nodes that are still large after so many levels are compared as they are.
DEEPEST = 60
#: So many sets that a leader's bits are near to are a crowd.
CROWD = 64
#: How often the sets of a crowd that are in no class of its centre meet another centre.
CENTRES = 3
#: Ids of sets that are needed for a comparison are broadcast up to this many.
BROADCAST_IDS = 1 << 20

_CHUNK, _BLOCK, _ROWS = 1 << 20, 1 << 22, 4096
_random = np.random.default_rng(13)
_FACTORS = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_OFFSETS = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_SHORTER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of an ordered pair of hashes."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed(words: list[bytes]) -> np.ndarray:
    import pyarrow as pa
    import xxhash

    encoded = pa.array(words, pa.binary()).dictionary_encode()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for w in encoded.dictionary.to_pylist()), np.uint64)
    return hashes[encoded.indices.to_numpy()]


def _shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The set of a document with these words, sorted."""
    if len(hashes) < k:
        whole = np.full(1, _SHORTER)
        for h in hashes:
            whole = _mixed(whole, h)
        return whole if len(hashes) else np.empty(0, np.uint64)
    found = hashes[: len(hashes) - k + 1]
    for i in range(1, k):
        found = _mixed(found, hashes[i : len(hashes) - k + 1 + i])
    return np.unique(found)


def _least(elements: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), _ROWS):
        part = elements[at : at + _ROWS, None] * _FACTORS + _OFFSETS
        np.minimum(least, part.min(axis=0), out=least)
    return least


def _sets(texts, shingle: int) -> Iterator[list[np.ndarray]]:
    """The sets of consecutive texts, a few megabytes of words at a time."""
    words, ends = [], []

    def taken():
        hashes = _hashed(words) if words else np.empty(0, np.uint64)
        return [_shingles(part, shingle) for part in np.split(hashes, ends)[:-1]]

    for text in texts:
        text = (text.as_py() or b"").lower()  # bytes: A-Z only
        if len(text) > _BLOCK:
            yield taken()
            words, ends = [], []
            yield [_shingles(np.concatenate([_hashed(b) for b in word_blocks(text) if b] or [np.empty(0, np.uint64)]), shingle)]
            continue
        words += text.split()
        ends.append(len(words))
        if len(words) >= _CHUNK:
            yield taken()
            words, ends = [], []
    yield taken()


def signatures(documents: DataFrame, id: str, text: str, shingle: int) -> DataFrame:
    """``id``, ``n``, ``digest`` (null: no shingle), ``bits0``, ``bits1``, ``least`` and ``text`` of each row.

    Texts take less room than the sets of them, which few rows are asked for later.
    """
    rows = documents.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def sign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = 0
            for sets in _sets(batch.column(1).cast(pa.binary()), shingle):
                if not sets:
                    continue
                least = np.stack([_least(s) for s in sets])
                bits = [np.packbits(least >> np.uint64(b) & np.uint64(1) == 1, axis=1).view(np.int64).ravel() for b in (0, 1)]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(bits[0]),
                        pa.array(bits[1]),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(len(sets) + 1, dtype=np.int32) * COORDINATES),
                            pa.array(least.view(np.int64).ravel()),
                        ),
                        batch.column(1).slice(at, len(sets)),
                    ],
                    names=["id", "n", "digest", "bits0", "bits1", "least", "text"],
                )
                at += len(sets)

    schema = f"id {id_type}, n bigint, digest binary, bits0 bigint, bits1 bigint, least array<bigint>, text string"
    return rows.mapInArrow(sign, schema)


def _whole(signed: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """``row`` and ``shingles``, the whole set, of the given rows."""
    if rows.count() <= BROADCAST_IDS:
        rows = F.broadcast(rows)

    def sets_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = 0
            for sets in _sets(batch.column(1).cast(pa.binary()), shingle):
                if not sets:
                    continue
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                shingles = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), shingles], names=["row", "shingles"])
                at += len(sets)

    return signed.select("row", "text").join(rows, "row", "left_semi").mapInArrow(sets_of, "row bigint, shingles array<bigint>")


def trees_for(recall: float, similarity: float, depth: int) -> int:
    """Trees that find a link of the least similarity with this probability, if it is ``depth`` levels deep."""
    second = 1 / similarity - 1  # probability of a second branch
    found = 1.0
    for _ in range(depth):
        missed = 1 - similarity * found
        found = 1 - (1 - second) * missed - second * missed**2
    return math.ceil(math.log(1 - recall) / math.log(1 - found))


def _children(rows: DataFrame, similarity: float, *kept: str) -> DataFrame:
    """The children of ``node`` in which a set with ``least`` goes on."""
    pick = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(COORDINATES)).cast("int")
    two = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(10_000)) < F.lit(round(10_000 * (1 / similarity - 1)))
    chosen = F.when(two, F.array(pick(1), pick(2))).otherwise(F.array(pick(1)))
    return rows.select("*", F.explode(F.array_distinct(chosen)).alias("i")).select(
        F.xxhash64("node", "i", F.get("least", F.col("i"))).alias("node"), *kept
    )


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether the sizes and the bits of two sets allow a link."""
    c = lambda side, name: F.col(f"{side}_{name}")
    differ = sum(F.bit_count(c(a, f"bits{i}").bitwiseXOR(c(b, f"bits{i}"))) for i in (0, 1))
    least, most = F.least(c(a, "n"), c(b, "n")), F.greatest(c(a, "n"), c(b, "n"))
    return (100 * least >= percent * most) & (differ <= DIFFERENT_BITS)


def _side(sets: DataFrame, side: str, *more: str) -> DataFrame:
    names = ["rep", "n", "bits0", "bits1", *more]
    return sets.select(*[F.col(c).alias(side if c == "rep" else f"{side}_{c}") for c in names])


def _confirmed(pairs: DataFrame, signed: DataFrame, percent: int, shingle: int, name: str) -> DataFrame:
    """Those of the pairs ``a``, ``b`` whose whole sets are similar enough."""
    pairs = staged(pairs, f"{name}-pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    sets = _whole(signed, staged(needed, f"{name}-needed"), shingle)
    a = sets.select(F.col("row").alias("a"), F.col("shingles").alias("a_set"))
    b = sets.select(F.col("row").alias("b"), F.col("shingles").alias("b_set"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    joined = pairs.join(a, "a").join(b, "b")
    return staged(
        joined.filter(100 * both >= percent * (F.size("a_set") + F.size("b_set") - both)).select("a", "b"),
        f"{name}-links",
    )


def _led(rows: DataFrame, level: int, name: str) -> DataFrame:
    """Rows of nodes with more than one class, written.

    With the ``leader`` of the node, its largest class ``major``, and how many
    pairs there are of a row of another class and any row, its ``work``.
    """
    order = F.lit(0x5DEECE66D * level)  # another leader on each level
    classes = rows.groupBy("node", "class").agg(
        F.count("*").alias("n"), F.min(F.col("rep").bitwiseXOR(order)).alias("least_rep")
    )
    nodes = classes.groupBy("node").agg(
        F.sum("n").alias("size"), F.max(F.struct("n", "class")).alias("major"), F.min("least_rep").alias("least_rep")
    ).filter("size > major.n")
    nodes = nodes.select(
        "node", F.col("major.class").alias("major"), (F.col("size") * (F.col("size") - F.col("major.n"))).alias("work"),
        F.col("least_rep").bitwiseXOR(order).alias("leader"),
    )
    return staged(rows.join(nodes, "node"), name)


def _near(rows: DataFrame, percent: int, *more: str, also: Column | None = None) -> DataFrame:
    """Pairs a < b of one node and different classes that may be linked."""
    rows = rows.select("node", "rep", "n", "bits0", "bits1", "class", (F.col("class") == F.col("major")).alias("main"), *more)
    a, b = (_side(rows, s, "node", "class", "main", *more) for s in "ab")
    pairs = a.filter("NOT a_main").join(b, F.col("a_node") == F.col("b_node")).filter(
        (F.col("b_main") | (F.col("a") < F.col("b"))) & (F.col("a_class") != F.col("b_class"))
        & _alike("a", "b", percent)
    )
    if also is not None:
        pairs = pairs.filter(also)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _star(rows: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Pairs of a set ``a`` and a leader ``b`` of one of its nodes that may be linked, written."""
    star = rows.filter("rep != leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    star = star.join(_side(sets, "a"), "a").join(_side(sets, "b"), "b").filter(_alike("a", "b", percent))
    return staged(star.select("a", "b"), name)


def _crowded(star: DataFrame) -> DataFrame:
    """Those pairs of a star whose leader many sets are near to, and that leader with itself."""
    leaders = star.groupBy("b").count().filter(F.col("count") >= CROWD).select("b")
    return star.join(leaders, "b", "left_semi").select("a", "b").unionByName(leaders.select(F.col("b").alias("a"), "b"))


def _as_crowd(rows: DataFrame, crowd: DataFrame) -> DataFrame:
    """The rows with those of the crowd in one class; no set's own number is negative."""
    crowd = crowd.select(F.col("a").alias("rep"), F.lit(True).alias("crowd")).distinct()
    return rows.join(crowd, "rep", "left").withColumn("class", F.when(F.col("crowd"), -1).otherwise(F.col("class"))).drop("crowd")


def _classes(sets: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """The sets with the ``class`` that links give them."""
    classes = block_components(found.select(F.col("a").alias("u"), F.col("b").alias("v")), f"{name}-classes")
    return staged(
        sets.select("rep", "n", "bits0", "bits1").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("class", F.coalesce("component", "rep")).drop("component"),
        f"{name}-known",
    )


def _ordered(members: DataFrame, signed: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The first elements of each set of a crowd, those that fewest sets of it have.

    With their ``position`` from 0 and a ``score``: the higher, the more sets have what
    this one has. An order that all sets follow is enough for results to be whole.
    """
    whole = _whole(signed, members.select(F.col("rep").alias("row")), shingle)
    elements = whole.select(F.col("row").alias("rep"), F.size("shingles").alias("n"), F.explode("shingles").alias("element"))
    holders = elements.groupBy("element").agg(F.count("*").alias("holders"))
    of_set = Window.partitionBy("rep")
    placed = elements.join(holders, "element").withColumns({
        "position": F.row_number().over(of_set.orderBy("holders", "element")) - 1,
        "score": F.avg("holders").over(of_set),
    })
    # all but as many as a linked set has at least
    first = placed.filter(100 * (F.col("n") - F.col("position")) >= percent * F.col("n"))
    return staged(first.select("rep", "element", "position", "score"), "paths-ordered")


def _crowd_pairs(
    crowd: DataFrame, sets: DataFrame, signed: DataFrame, found: DataFrame, percent: int, shingle: int
) -> tuple[DataFrame, DataFrame]:
    """Links and further pairs that may be links between the sets of a crowd; ``crowd`` has them with their leaders.

    Each meets the sets that have most in common with those of its leader. After that
    two sets of different classes are a pair if they share an element that comes so
    early in both that what follows it is enough for a link: true of the first
    element that linked sets share.
    """
    crowd = staged(crowd.distinct(), "paths-crowd")
    members = staged(crowd.select(F.col("a").alias("rep")).distinct(), "paths-members")
    ordered = _ordered(members, signed, percent, shingle)
    scores = ordered.filter("position = 0").select(F.col("rep").alias("a"), "score")
    sets = staged(sets.select("rep", "n", "bits0", "bits1").join(members, "rep", "left_semi"), "paths-crowd-sets")
    links, known = found, _classes(sets, found, "paths-crowd")

    def apart(met: DataFrame) -> DataFrame:
        """Those that are not known to be in one class with their centre."""
        a, centre = (known.select(F.col("rep").alias(c), F.col("class").alias(f"{c}_class")) for c in ("a", "centre"))
        return met.join(a, "a").join(centre, "centre").filter("a_class != centre_class").select("a", "b", "centre")

    for _ in range(CENTRES):  # the centres after the first are of other classes
        centres = crowd.join(scores, "a").groupBy("b").agg(F.max_by("a", F.struct("score", "a")).alias("centre"))
        met = crowd.join(centres, "b")
        pairs = apart(met).select("a", F.col("centre").alias("b")).distinct()
        pairs = pairs.join(_side(sets, "a"), "a").join(_side(sets, "b"), "b").filter(_alike("a", "b", percent))
        links = links.unionByName(_confirmed(pairs.select("a", "b"), signed, percent, shingle, "paths-centre"))
        known = _classes(sets, links, "paths-crowd")
        crowd = staged(apart(met).select("a", "b"), "paths-crowd")
    rows = ordered.select("rep", "position", F.col("element").alias("node")).join(known, "rep")
    left = F.least(F.col("a_n") - F.col("a_position"), F.col("b_n") - F.col("b_position"))
    enough = (100 + percent) * left >= percent * (F.col("a_n") + F.col("b_n"))
    pairs = _near(_led(rows, 0, "paths-elements"), percent, "position", also=enough)
    return links, staged(pairs.distinct(), "paths-crowd-near")


def links(
    sets: DataFrame, signed: DataFrame, percent: int = 80, recall: float = RECALL, small: int = SMALL_NODE,
    shingle: int = 2,
) -> DataFrame:
    """Links ``a``, ``b`` between different sets that connect what is connected; ``sets`` has one row for each.

    On the first level every set meets its leaders, and the least of those that
    its bits are near to in small nodes. The classes that this gives leave few
    pairs to compare, however large groups are; crowds are compared apart.
    """
    similarity = percent / 100
    trees = trees_for(recall, similarity, DEPTH)
    carried = ["rep", "n", "bits0", "bits1", "class"]
    roots = sets.select("*", F.col("rep").alias("class"), F.explode(F.expr(f"sequence(1L, {trees}L)")).alias("node"))
    rows = _led(_children(roots, similarity, *carried), 0, "paths-1")

    star = _star(rows, sets, percent, "paths-star")
    crowd = staged(_crowded(star), "paths-crowd")
    few = _as_crowd(rows.filter(F.col("work") <= small**2), crowd)
    nearest = _near(few, percent).groupBy("b").agg(F.min("a").alias("a"))
    pairs = star.select(F.col("b").alias("a"), F.col("a").alias("b")).unionByName(nearest).distinct()
    found = _confirmed(pairs, signed, percent, shingle, "paths-first")
    known = staged(_as_crowd(_classes(sets, found, "paths"), crowd), "paths-known")
    rows = _led(rows.select("node", "rep").join(known, "rep"), 0, "paths-rows")

    candidates, crowds = [], [crowd]
    level = 1
    while True:
        few = rows if level >= DEEPEST else rows.filter(F.col("work") <= small**2)
        candidates.append(staged(_near(few, percent).distinct(), "paths-near"))
        many = rows.filter(F.col("work") > small**2)
        if level >= DEEPEST or not many.limit(1).count():
            break
        if level > 1:  # the first level's rows have met their leaders
            crowd = staged(_crowded(_star(many, sets, percent, "paths-star")), "paths-crowd")
            many = _as_crowd(many, crowd)
            crowds.append(crowd)
        level += STEP
        grown = many.select("node", *carried).join(sets.select("rep", "least"), "rep")
        for _ in range(STEP):
            grown = _children(grown, similarity, *carried, "least")
        rows = _led(grown.select("node", *carried), level, f"paths-{level}")
    crowd = reduce(DataFrame.unionByName, crowds)
    if crowd.limit(1).count():
        found, pairs = _crowd_pairs(crowd, sets, signed, found, percent, shingle)
        candidates.append(pairs)
    pairs = reduce(DataFrame.unionByName, candidates).distinct()
    return found.unionByName(_confirmed(pairs, signed, percent, shingle, "paths-near"))


def near_duplicates(
    documents: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 2, percent: int = 80,
    recall: float = RECALL, small: int = SMALL_NODE,
) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` (the smallest id reachable) and ``kept`` of each row.

    Two documents are linked if their sets of different word shingles have an
    intersection of ``percent`` of their union. A-Z count as a-z. A text with fewer
    words than a shingle is one shingle; one without words, or a null one, has none
    and is linked with nothing. Equal sets are always linked. Rows with a null id
    are members that never name a component and are not kept; of rows with one id
    all are kept or none. Other columns do not matter. Shingles are compared by 64 bits.
    """
    signed = staged(
        signatures(documents, id, text, shingle).withColumn("row", F.monotonically_increasing_id()), "paths-signed"
    )
    full = signed.filter("digest IS NOT NULL")
    equal = staged(
        full.groupBy("digest").agg(F.min("row").alias("rep"), F.min("id").alias("first"), F.count("*").alias("copies")),
        "paths-equal",
    )
    sets = staged(
        signed.select(F.col("row").alias("rep"), "n", "bits0", "bits1", "least").join(equal.select("rep"), "rep", "left_semi"),
        "paths-sets",
    )
    found = links(sets, signed, percent, recall, small, shingle).select(F.col("a").alias("u"), F.col("b").alias("v"))
    members = staged(block_components(found, "paths-components").withColumnRenamed("node", "rep"), "paths-members")
    # a member's class, and of the class the smallest id
    least = staged(
        members.join(equal.select("rep", "first"), "rep").groupBy("component")
        .agg(F.min("first").alias("least"), F.count("*").alias("size")),
        "paths-least",
    )
    total = least.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    named = join_keyed(members, least, "component", "size", total).select("rep", "least")
    keyed = staged(
        equal.join(named, "rep", "left").select("digest", "copies", F.coalesce("least", "first").alias("component_id")),
        "paths-named",
    )
    rows = signed.select("id", "n", "digest")
    total = keyed.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    whole = join_keyed(rows.filter("digest IS NOT NULL"), keyed, "digest", "copies", total)
    empty = rows.filter("digest IS NULL").withColumn("component_id", F.col("id"))
    return whole.unionByName(empty).select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
