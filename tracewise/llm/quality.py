"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and
one bit per failed rule, so that policies (sets of rules, by version) and
ablations are bitwise operations on it and never touch a text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm.common import words

#: Rule k sets bit k of ``failed`` where its condition on the measurements holds.
#: Conditions are plain SQL, so that they read the same in any engine.
RULES = (
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("short_mean_word", "word_chars < 2 * n_words"),
    ("long_mean_word", "word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("upper_case", "2 * n_upper > word_chars"),
    ("exclamations", "2 * n_bangs > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 7 * n_lines"),
)

#: Versions of policies: the rules that reject. Earlier versions are never changed.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": tuple(name for name, _ in RULES),
}

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_bangs",
)


def mask(policy: str) -> int:
    """The bits of the rules of a policy."""
    names = [name for name, _ in RULES]
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def _repeat_words(array: Column) -> Column:
    """The number of words in windows of three that the array holds twice or more.

    If the hashes of the windows are distinct, so are the windows. Otherwise the
    windows are sorted with their places; equal neighbours are the repeated ones.
    """
    windows = F.size(array) - 2
    places = F.sequence(F.lit(0), windows - 1)
    hashes = F.transform(
        places, lambda i: F.xxhash64(F.get(array, i), F.get(array, i + 1), F.get(array, i + 2))
    )
    ordered = F.sort_array(
        F.arrays_zip(
            *(F.slice(array, k + 1, windows).alias(f"w{k}") for k in range(3)), places.alias("i")
        )
    )

    def starts(ordered: Column) -> Column:
        equal = F.zip_with(
            F.slice(ordered, 1, windows - 1),
            F.slice(ordered, 2, windows - 1),
            lambda a, b: F.when(
                (a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"]),
                F.array(a["i"], b["i"]),
            ),
        )
        return F.flatten(F.array_compact(equal))

    def covered(starts: Column) -> Column:
        second, third = F.transform(starts, lambda i: i + 1), F.transform(starts, lambda i: i + 2)
        return F.size(F.array_distinct(F.concat(starts, second, third)))

    # lambdas over a single element: what they are given is computed once
    exact = F.transform(F.transform(F.array(ordered), starts), covered)[0]
    return (
        F.when(windows < 2, 0)
        .when(F.size(F.array_distinct(hashes)) == windows, 0)
        .otherwise(exact)
        .cast("bigint")
    )


def _count(text: Column, characters: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("bigint")


def ledger(documents: DataFrame, text: str = "text") -> DataFrame:
    """All columns, with the measurements and ``failed``, a bit for each failed rule.

    A null text has no words. A column of the input that has the name of a
    measurement, or ``failed``, gives way.
    """
    kept = [c for c in documents.columns if c.lower() not in {*MEASURES, "failed"}]
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    measures = F.struct(
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("bigint").alias("word_chars"),
        _count(t, "#*$%&|<>").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        _count(t, r"\p{Lu}").alias("n_upper"),
        (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("bigint").alias("n_bangs"),
    )
    # made by a generator, so that a filter on the ledger is not computed from the text again
    measured = documents.select(
        "*", words(t).alias("_words"), lines.alias("_lines")
    ).select(*kept, F.inline(F.array(measures)))
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)]
    failed = bits[0].cast("bigint")
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit.cast("bigint"))
    return measured.withColumn("failed", failed)


def rejects(policy: str, failed: str = "failed") -> Column:
    """Whether a row of the ledger fails a rule of the policy."""
    return F.col(failed).bitwiseAND(F.lit(mask(policy))) != 0


def ablation(rows: DataFrame, policy: str, failed: str = "failed") -> DataFrame:
    """What each rule of a policy does, from a ledger: ``rule``, ``fails`` (rows that fail it),
    ``fails_alone`` (rows that would be kept without it), ``kept_without`` (all rows kept then).

    One aggregation over combinations of bits, then a row for each rule.
    """
    whole = mask(policy)
    seen = rows.groupBy(F.col(failed).bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    out = []
    for k, (name, _) in enumerate(RULES):
        if whole >> k & 1:
            bit, rest = F.lit(1 << k), F.lit(whole & ~(1 << k))
            out.append(
                F.struct(
                    F.lit(name).alias("rule"),
                    F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("n"))), F.lit(0)).alias("fails"),
                    F.coalesce(F.sum(F.when(F.col("bits") == bit, F.col("n"))), F.lit(0)).alias("fails_alone"),
                    F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(rest) == 0, F.col("n"))), F.lit(0)).alias("kept_without"),
                )
            )
    return seen.agg(F.array(*out).alias("rows")).select(F.inline("rows"))
