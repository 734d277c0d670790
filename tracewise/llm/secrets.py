"""Secret scans: broad candidates, and a random forest that removes the false positives.

Everything is DataFrame expressions and the JVM's own forest. A candidate is a
run of 16 or more characters that keys are made of. The forest sees its length
and make-up, its character transitions, how much of it dictionary words cover,
signs of paths and addresses around it and the words before and after.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm.common import positional, staged, words

PATTERN = r"[A-Za-z0-9+/_\-]{16,}={0,2}"
#: Signs that have transitions of their own: letters, then 0 for any digit; others share a place.
SIGNS = "abcdefghijklmnopqrstuvwxyz0"

#: Words that name a secret, as a part of the word before it. Fixed values.
KEY_WORDS = "token|secret|passw|pwd|apikey|api_key|api-key|access_key|private|credential|auth|bearer"

#: A dictionary word occurs at least so often in the corpus.
DICTIONARY_COUNT = 5

#: At most so many labelled findings of either kind are used to train.
TRAIN_ROWS = 20_000

FEATURES = (
    "length", "digits", "upper", "lower", "other", "distinct", "changes", "unlikely",
    "covered", "slashes", "in_address", "key_before", "assigned", "quoted", "long_neighbours",
)


def candidates(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each candidate: the id, ``place`` (its word, from 0), ``candidate``, ``word`` and neighbours.

    Null and blank texts have none.
    """
    found = documents.filter(F.col(text).rlike(PATTERN)).select(F.col(id), words(F.col(text)).alias("w"))
    word = lambda i: F.get("w", i)
    long_words = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.length(word(i)) >= 16)
    around = F.transform(
        long_words,
        lambda i: F.struct(
            i.alias("place"), word(i).alias("word"), word(i - 2).alias("before2"),
            word(i - 1).alias("before1"), word(i + 1).alias("after1"),
        ),
    )
    rows = found.select(id, F.explode(around).alias("a")).select(id, "a.*")
    return rows.select("*", F.explode(F.regexp_extract_all("word", F.lit(PATTERN), F.lit(0))).alias("candidate"))


def dictionary(documents: DataFrame, text: str = "text", least: int = DICTIONARY_COUNT) -> DataFrame:
    """``part``: starts of words of 3 or more letters, in lower case, found at least ``least`` times in all texts."""
    parts = documents.select(F.explode(words(F.lower(text))).alias("word"))
    parts = parts.select(F.regexp_extract("word", "^[a-z]{3,}", 0).alias("part")).filter("part != ''")
    return parts.groupBy("part").count().filter(F.col("count") >= least).select("part")


def _signs(text: Column) -> Column:
    """The places of a text's characters in ``SIGNS``, 0 for others."""
    plain = F.translate(F.lower(text), "123456789", "000000000")
    return F.transform(F.split(plain, ""), lambda c: F.position(c, F.lit(SIGNS)))


def _pairs(signs: Column) -> Column:
    """Numbers of the pairs of neighbouring signs."""
    n = F.size(signs)
    return F.zip_with(
        F.slice(signs, 1, n - 1), F.slice(signs, 2, n - 1), lambda a, b: a * (len(SIGNS) + 1) + b
    )


def transitions(known: DataFrame) -> list[float]:
    """Minus the log probability of every pair of signs in dictionary words, by the pair's number."""
    n = len(SIGNS) + 1
    seen = known.select(F.explode(_pairs(_signs(F.col("part")))).alias("pair")).groupBy("pair").count()
    counts = {r["pair"]: r["count"] for r in seen.collect()}  # one row for each pair of signs at most
    total = sum(counts.values()) + n * n
    return [-math.log((counts.get(k, 0) + 1) / total) for k in range(n * n)]


def features(found: DataFrame, known: DataFrame, costs: list[float]) -> DataFrame:
    """The candidates with ``FEATURES``; ``known`` has the dictionary in ``part``."""
    c, n = F.col("candidate"), F.length("candidate")
    share = lambda signs: (n - F.length(F.regexp_replace(c, f"[{signs}]", ""))) / n
    head = F.expr("substring_index(word, candidate, 1)")
    before = F.lower(F.concat_ws(" ", "before2", "before1", head))
    kinds = c
    for signs, one in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), ("[^aA0]+", "_")):
        kinds = F.regexp_replace(kinds, signs, one)
    table = F.array(*map(F.lit, costs))
    unlikely = F.aggregate(
        _pairs(_signs(c)), F.lit(0.0), lambda total, k: total + F.get(table, k)
    ) / F.greatest(n - 1, F.lit(1))
    flag = lambda condition: F.when(condition, 1.0).otherwise(0.0)
    rows = found.withColumns(
        {
            "length": n.cast("double"),
            "digits": share("0-9"),
            "upper": share("A-Z"),
            "lower": share("a-z"),
            "other": share("^A-Za-z0-9"),
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
            "changes": (F.length(kinds) - 1) / n,
            "unlikely": unlikely,
            "slashes": share("/"),
            "in_address": flag(F.col("word").rlike(r"://|@|^\W*/|\.(com|org|net)\b")),
            "key_before": flag(before.rlike(KEY_WORDS)),
            "assigned": flag(before.rlike(r"[=:]\W*$")),
            "quoted": flag(F.col("word").rlike("[\"'`]")),
            "long_neighbours": F.coalesce(F.length("before1"), F.lit(0)) + F.coalesce(F.length("after1"), F.lit(0)) + 0.0,
        }
    )
    parts = F.transform(F.regexp_extract_all("candidate", F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0)), F.lower)
    own = rows.select("candidate").distinct().select("candidate", F.explode(parts).alias("part"))
    covered = own.join(known, "part").groupBy("candidate").agg(F.sum(F.length("part")).alias("_covered"))
    joined = rows.join(covered, "candidate", "left")
    return joined.withColumn("covered", F.coalesce(F.col("_covered") / n, F.lit(0.0))).drop("_covered")


def sure_label() -> Column:
    """The label of a finding that a rule is sure of: 1.0, 0.0, or null where it is not.

    Sure secrets mix letters with digits, have no run of five letters beyond f and are
    assigned to a name that says so; sure false alarms are letters only or digits only.
    """
    c = F.col("candidate")
    mixed = c.rlike("[0-9]") & c.rlike("[A-Za-z]")
    return F.when(
        mixed & ~c.rlike("[G-Zg-z]{5}") & (F.col("key_before") > 0) & (F.col("assigned") > 0), 1.0
    ).when(~mixed, 0.0)


def scan(
    documents: DataFrame, id: str = "doc_id", text: str = "text", label: Column | None = None,
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """Findings: the id, ``place``, ``candidate``, ``length``, ``label``, ``probability``, ``is_secret``.

    ``label`` says what is known of a finding (1.0, 0.0, null), from its columns;
    by default it is ``sure_label()``. The forest is trained on ``train_rows``
    findings of either kind at most, chosen by hash, and judges all findings.
    Without both kinds of labels there is nothing to train: the labels decide
    then, and open findings count as secrets with a probability of 0.5.
    """
    found = staged(candidates(documents, id, text), "secret-candidates")
    known = staged(dictionary(documents, text), "secret-dictionary")
    made = features(found, known, transitions(known))
    made = staged(made.withColumn("label", sure_label() if label is None else label), "secret-features")
    order = F.xxhash64("candidate", "place")
    kinds = [made.filter(F.col("label") == kind).orderBy(order).limit(train_rows) for kind in (0.0, 1.0)]
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
    train = gather.transform(kinds[0].unionByName(kinds[1])).select("_features", "label")
    if made.filter("label = 0").isEmpty() or made.filter("label = 1").isEmpty():
        judged = made.withColumn("probability", F.coalesce("label", F.lit(0.5)))
    else:
        forest = RandomForestClassifier(
            featuresCol="_features", labelCol="label", numTrees=24, maxDepth=6, seed=7,
            featureSubsetStrategy="sqrt",
        ).fit(train)
        judged = forest.transform(gather.transform(made)).withColumn(
            "probability", vector_to_array("probability")[1]
        )
    return judged.select(
        id, "place", "candidate", F.col("length").cast("int"), "label", "probability",
        (F.col("probability") >= 0.5).alias("is_secret"),
    )


def redact(documents: DataFrame, text: str = "text", mark: str = "[SECRET]", **scan_options) -> DataFrame:
    """The documents with every secret in the text replaced; ``n_chars`` follows if it is there.

    All other columns stay as they are, whatever their names. Equal rows are cleaned alike.
    """
    docs, (body, n_chars) = positional(documents, text, "n_chars")
    keyed = staged(docs.withColumn("_key", F.monotonically_increasing_id()), "secret-documents")
    found = scan(keyed.select("_key", body), "_key", body, **scan_options).filter("is_secret")
    own = staged(found.groupBy("_key").agg(F.collect_set("candidate").alias("_secrets")), "secret-found")
    # long ones first: a secret may be a part of another
    ordered = F.array_sort("_secrets", lambda a, b: F.length(b) - F.length(a))
    cleaned = F.aggregate(ordered, F.col(body), lambda t, s: F.replace(t, s, F.lit(mark)))
    out = keyed.join(own, "_key", "left").withColumn(
        body, F.when(F.col("_secrets").isNull(), F.col(body)).otherwise(cleaned)
    )
    if n_chars:
        kind = docs.schema[n_chars].dataType
        out = out.withColumn(
            n_chars, F.when(F.col("_secrets").isNull(), F.col(n_chars)).otherwise(F.length(body).cast(kind))
        )
    return out.select(docs.columns).toDF(*documents.columns)
