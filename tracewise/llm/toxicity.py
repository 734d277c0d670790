"""Toxicity by maximum-scoring segments.

Tokens (short words and the starts of words) get log-odds of toxic against clean
documents under a Dirichlet prior; words with a token that stands out score its
log-odds, all others a small loss. One pass over a text
finds all its maximal segments (none can be made better by growing or shrinking).
The best score of a text of n words without toxic passages follows an extreme-value
law; its parameters turn scores into evidence, and a logistic curve fitted on the
labelled documents turns the evidence into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm.common import staged

#: Labelled documents that the model is fitted on, and words it may have, at most.
TRAIN_ROWS, MAX_WORDS = 200_000, 50_000
#: Weight of the prior (in documents with a token, and half a document more for each token), the
#: least z and log-odds of a token of the model, the loss of words without one.
PRIOR, LEAST_Z, LEAST_ODDS, LOSS = 1000.0, 3.5, 1.0, 0.02
#: Lengths of the starts of words that are tokens, the end mark included: stems and whole short words.
STARTS = range(4, 9)
#: Words whose scores a Python worker remembers.
REMEMBER = 400_000
#: Segments this likely in a clean text of the same length are reported.
SIGNIFICANT = 0.01

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall((text or "").lower())


def tokens_of(word: str) -> list[str]:
    """The tokens of a word: its starts, with a mark for its end, as a whole if it is short."""
    marked = word + "$"
    return [marked[:n] for n in STARTS if n <= len(marked)] or [marked]


class _Scores(dict):
    """The score of a word: the largest log-odds of its tokens, None without any."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: str) -> float | None:
        if len(self) > REMEMBER:
            self.clear()
        known = [self.odds[t] for t in tokens_of(word) if t in self.odds]
        found = self[word] = max(known) if known else None
        return found

    def __reduce__(self):
        return _Scores, (self.odds,)


def maximal_segments(scores: list[tuple[int, float]], n: int, loss: float) -> list[tuple[int, int, float]]:
    """All maximal segments (start, end, score) of a sequence of n scores, in linear time.

    ``scores`` has the places with a score above zero; all other places score
    ``-loss``. A segment is maximal if no part and no extension of it scores more.
    """
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at the end
    total, at = 0.0, 0
    for place, score in scores:
        total -= loss * (place - at)
        start, low = place, total
        total += score
        at = place + 1
        end, high = at, total
        # join with earlier segments as long as that makes a better one
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= low:
                k -= 1
            if k < 0 or found[k][3] >= high:
                found.append((start, end, low, high))
                break
            start, low = found[k][0], found[k][2]
            del found[k:]
    return [(s, e, high - low) for s, e, low, high in found]


@dataclass
class Model:
    odds: dict[str, float]
    scale: float = 1.0  # lambda of the extreme-value law
    factor: float = 1.0  # its K
    offset: float = 0.0
    slope: float = 0.0
    loss: float = LOSS

    def __post_init__(self):
        self.scores = _Scores(self.odds)

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        """The number of words of a text, and the places and scores of those that have one."""
        words = words_of(text)
        found = map(self.scores.__getitem__, words)
        return len(words), [(i, s) for i, s in enumerate(found) if s is not None]

    def evidence(self, n: int, score: float) -> float:
        """Minus the log of how many segments of that score a clean text of n words would have."""
        return self.scale * score - math.log(self.factor * max(n, 1))

    def total(self, n: int, scores: list[float]) -> float:
        """The evidence of all segments together: of those that a clean text would not have, or of the best."""
        each = [self.evidence(n, s) for s in scores] or [self.evidence(n, 0.0)]
        return sum(e for e in each if e > 0) or max(each)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(max(self.offset + self.slope * evidence, -500), 500)))


def token_counts(labelled: DataFrame) -> DataFrame:
    """``token``, ``toxic``, ``clean``: how many texts of either label have each token.

    A text counts once for a token, so that one that repeats a word says no more.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 2000):
                both = Counter(), Counter()
                for text, label in zip(batch["text"][start : start + 2000], batch["label"][start : start + 2000]):
                    both[int(label)].update({t for w in set(words_of(text)) for t in tokens_of(w)})
                tokens = list(both[0].keys() | both[1].keys())
                if tokens:  # texts without words have nothing to tell
                    yield pd.DataFrame(
                        {"token": tokens, "toxic": [both[1][t] for t in tokens], "clean": [both[0][t] for t in tokens]}
                    )

    seen = labelled.select("text", "label").mapInPandas(count, "token string, toxic bigint, clean bigint")
    return seen.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame, prior: float = PRIOR) -> DataFrame:
    """The counts with ``odds``, the difference of log-odds under the prior, and its ``z``."""
    toxic, clean = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    toxic, clean = float(toxic or 0), float(clean or 0)
    share = prior * (F.col("toxic") + F.col("clean")) / max(toxic + clean, 1) + 0.5
    a, b = F.col("toxic") + share, F.col("clean") + share
    odds = F.log(a / (toxic + prior - a)) - F.log(b / (clean + prior - b))
    return counts.withColumns({"odds": odds, "z": odds / F.sqrt(1 / a + 1 / b)})


def _scale(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda at which the mean of exp(lambda * score) is 1."""
    low, high = 1e-6, 1.0
    mean = lambda x: float((weights * np.exp(np.minimum(x * scores, 700))).sum())
    while mean(high) < 1 and high < 1e3:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    return (low + high) / 2


def _logistic(x: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """Offset and slope of a logistic curve through counts, with a weak pull to slope 0."""
    a, b = 0.0, 0.0
    n = positive + negative
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -500, 500)))
        g = np.array([(positive - n * p).sum(), ((positive - n * p) * x).sum() - 0.01 * b])
        w = n * p * (1 - p)
        h = np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(labelled: DataFrame) -> Model:
    """A model from ``text`` and ``label`` (0 or 1); null texts are empty, null labels take no part.

    Without rows of both labels every probability is near the label there is, or 0.
    """
    labelled = labelled.filter(F.col("label").isin(0, 1))
    counts = staged(log_odds(staged(token_counts(labelled), "toxic-counts")), "toxic-odds")
    known = counts.filter((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS))
    rows = known.orderBy(F.desc("z"), "token").limit(MAX_WORDS).collect()  # bounded by MAX_WORDS
    model = Model({r["token"]: r["odds"] for r in rows})

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, label in zip(batch["text"], batch["label"]):
                n, hits = model.hits(text)
                scores = [s for *_, s in maximal_segments(hits, n, model.loss)]
                out.append((int(label), max(n, 1), [round(s, 1) for _, s in hits], scores))
            yield pd.DataFrame(out, columns=["label", "n", "hits", "scores"])

    judged = labelled.select("text", "label").mapInPandas(
        judge, "label int, n bigint, hits array<double>, scores array<double>"
    )
    judged = staged(judged, "toxic-judged")
    clean = judged.filter("label = 0")
    n, words = clean.agg(F.count("*"), F.sum("n")).first()
    if n and rows:
        # scores of words in clean texts; log-odds to one decimal, so they are few
        seen = clean.select(F.explode("hits").alias("s")).groupBy("s").count().collect()
        scores = np.array([r["s"] for r in seen] + [max(model.odds.values()), -LOSS])
        times = np.array([r["count"] for r in seen] + [0.5, 0.0], float)
        times[-1] = max(words - times.sum(), 1.0)
        model.scale = _scale(scores, times / times.sum())
        # the likeliest K for the best segments of clean texts
        best = F.coalesce(F.array_max("scores"), F.lit(0.0))
        expected = clean.agg(F.sum(F.col("n") * F.exp(-F.lit(model.scale) * best))).first()[0]
        model.factor = n / expected if expected else 1.0
    each = F.transform("scores", lambda s: F.lit(model.scale) * s - F.log(F.lit(model.factor) * F.col("n")))
    sure = F.aggregate(F.filter(each, lambda e: e > 0), F.lit(0.0), lambda a, e: a + e)
    none = -F.log(F.lit(model.factor) * F.col("n"))
    evidence = F.when(sure > 0, sure).otherwise(F.coalesce(F.array_max(each), none))
    step = F.round(F.least(F.greatest(evidence, F.lit(-50.0)), F.lit(150.0)) * 4) / 4
    bins = judged.groupBy(step.alias("x")).agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()
    x, p, n = (np.array([float(r[c]) for r in bins]) for c in range(3))
    if len(x) and 0 < p.sum() < n.sum():
        model.offset, model.slope = _logistic(x, p, n - p)
    else:
        model.offset = 500.0 if len(x) and p.sum() else -500.0
    return model


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns but the text, with ``score``, ``n_tokens``, and ``passages``: significant segments,
    as (start and end in words, score, p-value). Columns of these names give way. Null texts are empty.
    """
    new = ("score", "n_tokens", "passages")
    kept = [c for c in documents.columns if c not in (text, *new)]

    @F.pandas_udf(
        "score double, n_tokens int, passages array<struct<start:int,end:int,score:double,p:double>>"
    )
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            n, hits = model.hits(t)
            found, told = maximal_segments(hits, n, model.loss), []
            for start, end, s in found:
                p = -math.expm1(-math.exp(min(-model.evidence(n, s), 700)))
                if p <= SIGNIFICANT:
                    told.append({"start": start, "end": end, "score": s, "p": p})
            total = model.total(n, [s for *_, s in found])
            rows.append((model.probability(total), n, told))
        return pd.DataFrame(rows, columns=list(new))

    return documents.select(*kept, judge(text).alias("_j")).select(*kept, "_j.*")
