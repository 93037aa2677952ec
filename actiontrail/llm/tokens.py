"""Exact, cached encoding with a public tokenizer file.

The tokenizers library is asked once per distinct word: white space always separates its pre-tokens, so the ids of
a text are the ids of its words in order. A worker keeps what it has learnt from task to task.
"""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np

KNOWN_WORDS = 600_000
END_TOKEN = "<|endoftext|>"
_MARKS = "!#$%&()*+,-./:;=?@[]^_{|}~"
_FAR = re.compile("[^\x00-\u024f]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Text to little-endian unsigned 32-bit ids, the same as `encode(text, add_special_tokens=False)`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Words met lately, and those met before them: half of the room each.
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.end_id = self.tokenizer.token_to_id(END_TOKEN)
        self.end = None if self.end_id is None else END_TOKEN

    @staticmethod
    def _words(text: str) -> list[str]:
        if not _FAR.search(text):
            # Below U+0250 lower-casing a text first cannot change what the tokenizer's own lower-casing gives.
            # The two special tokens are written in lower case, so they have to be there before.
            low = text.lower()
            text = text if "<|" in text else low
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def _learn(self, words: set[str]) -> None:
        """A letter followed by marks always ends a pre-token, so stems and trailing marks are learnt apart."""
        known, parts = self.known, {}
        unseen = words.difference(self.old)
        for w in words - unseen:
            known[w] = self.old[w]
        words = unseen
        for w in words:
            stem = w.rstrip(_MARKS)
            if stem and stem != w and stem[-1].isascii() and stem[-1].isalpha():
                parts[w] = (stem, w[len(stem):])
        fresh = []
        for x in {x for pair in parts.values() for x in pair if x not in known} | (words - parts.keys()):
            if x in self.old:
                known[x] = self.old[x]
            else:
                fresh.append(x)
        # Words are encoded together, apart by the end token, which stands in no word without "<".
        plain = [w for w in fresh if "<" not in w]
        for w in fresh if self.end is None else (w for w in fresh if "<" in w):
            known[w] = array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()
        for i in range(0, len(plain) if self.end is not None else 0, 5000):
            part = plain[i:i + 5000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([self.end.join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = [*(np.flatnonzero(ids == self.end_id) * 4).tolist(), 4 * len(ids)]
            raw, last = ids.tobytes(), 0
            for w, end in zip(part, ends, strict=True):
                known[w] = raw[last:end]
                last = end + 4
        for w, (stem, marks) in parts.items():
            known[w] = known[stem] + known[marks]

    def _joined(self, texts: list[list[str]]) -> list[bytes]:
        if len(self.known) > KNOWN_WORDS:
            self.old, self.known = self.known, {"": b""}
        missing = set().union(*texts).difference(self.known)
        if missing:
            self._learn(missing)
        known = self.known.__getitem__
        return [b"".join(map(known, words)) for words in texts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        step: list[list[str]] = []
        size = 0
        for text in texts:
            words = self._words(text) if text else []
            step.append(words)
            size += len(words)
            if size > 100_000:
                out += self._joined(step)
                step, size = [], 0
        return out + self._joined(step)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, so that known words are kept from task to task."""
    return Encoder(path)
