"""Token counts of every prefix of a text, by dynamic programming.

For byte-pair encoding, the encoding of a prefix is that of a shorter prefix and
one last token, and exactly one token fits: the one whose pair with the last
token before it would be encoded as these two. So the last token and the count
of every prefix follow from those of shorter ones, in one pass. With the counts
of all prefixes stored, any question about truncation or budgets is a lookup.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The split of byte-level BPE into pieces, a fixed value of the format.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))
_SPACES = regex.compile(r"\s+")
#: Where a text may be cut without a change: before a single space between two words.
_CUT = regex.compile(r"(?<=\S)(?= \S)")
_ODD = regex.compile(r"\s\s|^\s|\s$|[\0\x1c-\x1f]")
#: In plain texts also around a single line end, and before a mark that ends a word.
_MARK = regex.compile(r"(?<=[A-Za-z])([,.])(?=\0|$)")

#: Words and pairs of tokens remembered by a Python worker, and the longest of the words.
REMEMBER, PAIRS, LONGEST = 700_000, 400_000, 60


@lru_cache(maxsize=1)
def _byte_signs() -> dict[str, int]:
    """The printable signs that stand for bytes in vocabulary files of this format."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


class PrefixCounts:
    """Counts of tokens for all prefixes of texts, under one vocabulary file."""

    def __init__(self, file: str):
        import json
        import os

        import public_tokenizers

        with open(file if os.path.sep in file else public_tokenizers.path(file), encoding="utf-8") as f:
            found = json.load(f)
        signs = _byte_signs()
        raw = lambda token: bytes(signs[c] for c in token)
        self.special = [t["content"] for t in found["added_tokens"] if t["special"]]
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        pairs = (m.split(" ") if isinstance(m, str) else m for m in found["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.tokens = {raw(t) for t in found["model"]["vocab"] if all(c in signs for c in t)}
        self.ends = {t[k:] for t in self.tokens for k in range(len(t))}
        #: by token: which tokens may follow it
        self.after: dict[bytes, dict[bytes, bool]] = {}
        self.pairs = 0
        #: the counts of words, a byte for each character
        self.known: dict[str, bytes] = {}

    def encode(self, piece: bytes) -> list[bytes]:
        """Byte-pair encoding of one short piece."""
        parts, ranks, none = [piece[i : i + 1] for i in range(len(piece))], self.ranks, 1 << 60
        while len(parts) > 1:
            found = [ranks.get(pair, none) for pair in zip(parts, parts[1:])]
            rank = min(found)
            if rank == none:
                break
            at = found.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, a: bytes, b: bytes) -> bool:
        """Whether the two tokens stay as they are side by side."""
        self.pairs += 1
        fit = self.after[a][b] = self.encode(a + b) == ([a, b] if a else [b])
        return fit

    def of_piece(self, piece: bytes) -> list[int]:
        """The count of tokens for every prefix of a piece, by bytes from 0."""
        if self.pairs > PAIRS:
            self.after.clear()
            self.pairs = 0
        after, ends, tokens = self.after, self.ends, self.tokens
        last, counts, follow = [b""], [0], [after.setdefault(b"", {})]
        for end in range(1, len(piece) + 1):
            found = []
            for start in range(end - 1, -1, -1):
                token = piece[start:end]
                if token in tokens:
                    found.append((start, token))
                elif token not in ends:
                    break
            for start, token in reversed(found):  # mostly the longest one fits
                fit = follow[start].get(token)
                if fit or (fit is None and self._fit(last[start], token)):
                    last.append(token)
                    counts.append(counts[start] + 1)
                    follow.append(after.setdefault(token, {}))
                    break
            else:
                raise ValueError("a byte has no token")
        return counts

    def _at_characters(self, piece: str) -> list[int]:
        """The counts at the ends of the characters of a piece."""
        raw = piece.encode()
        found = self.of_piece(raw)[1:]
        if len(raw) > len(piece):  # a character ends where no byte that follows continues it
            found = [n for n, follows in zip(found, raw[1:] + b"a") if follows & 0xC0 != 0x80]
        return found

    def of_part(self, text: str) -> list[int]:
        """The counts for every prefix of a text without special tokens, by characters."""
        pieces = PIECES.findall(text)
        if len(pieces) == 1 and text not in _CONTRACTIONS:
            return self._at_characters(text)
        out, base, spaces = [], 0, False
        for piece in pieces:
            counts = self._at_characters(piece)
            if piece in _CONTRACTIONS:
                # shorter prefixes of it are an apostrophe and a letter
                mark = self._at_characters("'")[0]
                counts = [mark, mark + self._at_characters(piece[1])[0], counts[-1]]
            out += [base + n for n in counts]
            base += counts[-1]
            spaces = spaces or piece.isspace()
        # a prefix that ends in white space has all of that run as one piece
        for run in _SPACES.finditer(text) if spaces else ():
            if run.end() - run.start() > 1:
                before = out[run.start() - 1] if run.start() else 0
                out[run.start() : run.end()] = [before + n for n in self._at_characters(run[0])]
        return out

    def _segment(self, text: str) -> np.ndarray:
        """The counts of a text without special tokens, by characters."""
        if not text:
            return np.zeros(0, np.int32)
        if _ODD.search(text):
            words = _CUT.split(text)
        else:
            plain = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
            words = _MARK.sub("\0\\1", plain).split("\0")
        known = self.known
        if len(known) > REMEMBER:
            known.clear()
        found = list(map(known.get, words))
        if None in found:
            for k, (w, counts) in enumerate(zip(words, found)):
                if counts is None:
                    if (counts := known.get(w)) is None:
                        counts = self.of_part(w)
                        if len(w) <= LONGEST:  # as many tokens at most
                            counts = known[w] = bytes(counts)
                    found[k] = counts
        tokens = np.fromiter((c[-1] for c in found), np.int32, len(found))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        short = all(type(c) is bytes for c in found)
        inner = (
            np.frombuffer(b"".join(found), np.uint8)
            if short
            else np.concatenate([np.frombuffer(c, np.uint8) if type(c) is bytes else np.array(c) for c in found])
        )
        return inner + np.repeat(np.cumsum(tokens, dtype=np.int32) - tokens, sizes)

    def of(self, text: str) -> np.ndarray:
        """The number of tokens of the first 1, 2, ... characters of a text, as the library has them.

        A special string is one token once it is whole; until then it is ordinary text.
        """
        marks = list(self.split.finditer(text)) if self.split else []
        if not marks:
            return self._segment(text)
        out, base, at = [], 0, 0
        for mark in marks:
            # up to the last character of the mark it is a part of the text before it
            out.append(base + self._segment(text[at : mark.end() - 1]))
            before = self._segment(text[at : mark.start()])
            base += (int(before[-1]) if len(before) else 0) + 1
            out.append(np.array([base], np.int32))
            at = mark.end()
        out.append(base + self._segment(text[at:]))
        return np.concatenate(out).astype(np.int32)


@lru_cache(maxsize=2)
def _counter(file: str) -> PrefixCounts:
    return PrefixCounts(file)


def with_prefix_tokens(
    documents: DataFrame, file: str, text: str = "text", name: str = "prefix_tokens"
) -> DataFrame:
    """The columns but the text, with the array of token counts: element k for the first k + 1 characters.

    Null and empty texts have an empty array. A column of that name gives way.
    """
    kept = [f for f in documents.schema.fields if f.name not in (text, name)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(file)
        for batch in batches:
            at, start = 0, 0
            held, rows = [], 0
            for value in batch.column(len(kept)):
                held.append(counter.of(value.as_py() or ""))
                rows += len(held[-1])
                at += 1
                if rows > 1 << 20 or at == batch.num_rows:
                    ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
                    part = batch.slice(start, at - start)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[: len(kept)], lists], [*(f.name for f in kept), name]
                    )
                    held, rows, start = [], 0, at

    schema = T.StructType([*kept, T.StructField(name, T.ArrayType(T.IntegerType()))])
    return documents.select(*(f.name for f in kept), text).mapInArrow(count, schema)


def tokens_in(prefix_tokens: Column, characters: Column | int | None = None) -> Column:
    """How many tokens the first so many characters (all by default) have, from the stored counts."""
    n = F.size(prefix_tokens) if characters is None else F.least(F.lit(characters), F.size(prefix_tokens))
    return F.coalesce(F.get(prefix_tokens, n - 1), F.lit(0)).cast("bigint")


def longest_prefix(prefix_tokens: Column, budget: Column | int) -> Column:
    """How many characters the longest prefix has that is within a budget of tokens."""
    places = F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(places), F.lit(0))
