"""Words and tokens of texts inside Python tasks."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

BLOCK = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists from about a megabyte each, so that one long text stays small."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + BLOCK)
        end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end


@lru_cache(maxsize=4)
def tokenizer(file: str):
    """A tokenizer file by path or by its public name, once per Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file if os.path.sep in file else public_tokenizers.path(file))


#: Lower-case letters that no normalisation changes, and marks that are no apostrophe.
_LETTERS = re.compile(r"([a-z\u00DF-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)")
_PROBE = " The  na\u00EFve\t CAF\u00C9's 12 words, \u00FCber-long...\nstra\u00DFe;(a) don't 3.5%%% e\u0301t\u00E9!? end "


class WordTokens:
    """Ids of a byte-level tokenizer that lowers case and never looks across white space, remembered by word.

    Ids are little-endian unsigned 32-bit numbers, so that joining bytes joins ids.
    """

    def __init__(self, file: str, remember: int = 1_000_000):
        from tokenizers.pre_tokenizers import ByteLevel

        self.file, self.remember, self.known = file, remember, {}
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        want = tokenizer(file).encode(_PROBE, add_special_tokens=False).ids
        if self.of(_PROBE.encode()) != array("I", want).tobytes():
            raise ValueError(f"{file} looks across white space or at case, or splits letters from marks otherwise")

    def of(self, text: bytes) -> bytes:
        if b"<|" not in text:  # special strings are found before case is lowered
            text = text.lower()
        return b"".join(self._block(words) for words in word_blocks(text))

    def _block(self, words: list[bytes]) -> bytes:
        return b"".join(self._ids(words))

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        try:
            return list(map(self.known.__getitem__, words))
        except KeyError:
            need = set(words)
        new = need.difference(self.known)
        if len(self.known) + len(new) > self.remember:
            self.known, new = {}, need
        self._learn(new)
        return list(map(self.known.__getitem__, words))

    def _learn(self, new: set[bytes]) -> None:
        known, whole, parted = self.known, set(), []
        tokenize = tokenizer(self.file).model.tokenize
        for w in new:
            # letters and the marks after them are apart for the tokenizer
            if not (found := _LETTERS.fullmatch(w.decode())):
                whole.add(w)
                continue
            letters, marks = found.groups()
            key, after = letters.encode(), marks.encode()
            if key not in known:
                mapped = letters if letters.isascii() else letters.translate(self.alphabet)
                known[key] = array("I", [t.id for t in tokenize(mapped)]).tobytes()
            if after:
                parted.append((w, key, after))
                if after not in known:
                    whole.add(after)
        whole = list(whole)
        encoded = tokenizer(self.file).encode_batch_fast([w.decode() for w in whole], add_special_tokens=False)
        for w, e in zip(whole, encoded):
            known[w] = array("I", e.ids).tobytes()
        for w, key, after in parted:
            known[w] = known[key] + known[after]


@lru_cache(maxsize=4)
def word_tokens(file: str) -> WordTokens:
    """The memory of a Python worker, shared by its tasks."""
    return WordTokens(file)
