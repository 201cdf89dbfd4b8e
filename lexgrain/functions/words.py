"""The words of a text, for use inside Arrow batches.

Words are the maximal runs of a-z and 0-9 after NFKD, without combining marks, in lower case.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_MARKS = re.compile("[" + "".join(re.escape(chr(i)) for i in range(0x300, 0x1FFFF) if unicodedata.combining(chr(i))) + "]")
_RUN = re.compile("[a-z0-9]+")


def folded(text: str) -> str:
    """NFKD without combining marks, in lower case."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return text.lower()


def words(text: str | None) -> list[str]:
    return _RUN.findall(folded(text)) if text else []


def _inside() -> str:
    """The characters that can stand in a word or vanish from it, as a class: all whose folding has a letter or digit, or is empty."""
    kept = [i for i in range(0x80, 0x20000) if not (f := folded(chr(i))) or _RUN.search(f)]
    spans, first = [], 0
    for k in range(1, len(kept) + 1):
        if k == len(kept) or kept[k] != kept[k - 1] + 1:
            spans.append(f"{re.escape(chr(kept[first]))}-{re.escape(chr(kept[k - 1]))}")
            first = k
    return "".join(spans)


#: A stretch between characters that separate words however they are folded: nearly always one word.
_STRETCH = re.compile(f"[A-Za-z0-9{_inside()}]+")


class _Numbers(dict):
    """stretch -> the number of its word; 0 where it is not exactly one word."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, stretch: str) -> int:
        import xxhash

        own = _RUN.findall(folded(stretch))
        if len(self) > self.most:
            self.clear()
        self[stretch] = n = (xxhash.xxh3_64_intdigest(own[0]) or 1) if len(own) == 1 else 0
        return n


class WordIds:
    """Stable 64-bit numbers of words, remembered per task up to a bounded number of entries."""

    def __init__(self, most: int = 200_000) -> None:
        self.most, self.known, self.numbers = most, {}, _Numbers(most)

    def of(self, text: str | None) -> np.ndarray:
        """The numbers of the words of a text, equal to ``self(words(text))``: each stretch is folded once and remembered."""
        if not text:
            return np.empty(0, np.uint64)
        found = _STRETCH.findall(text)
        out = np.fromiter(map(self.numbers.__getitem__, found), np.uint64, len(found))
        if len(out) and not out.all():
            # stretches of no word or several ones
            flat: list[int] = []
            for w, n in zip(found, out.tolist()):
                flat += [n] if n else self(words(w)).tolist()
            out = np.array(flat, np.uint64)
        return out

    def __call__(self, some: list[str]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > self.most:
            known.clear()
        out = []
        for w in some:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w) or 1
            out.append(h)
        return np.array(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: A factor for each place of a run: odd numbers, so that no word is lost and order counts.
_PLACES = np.random.default_rng(2024).integers(0, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for every run of n (at most 64) consecutive words; empty where the text is shorter."""
    if len(ids) < n:
        return np.empty(0, dtype=np.uint64)
    m = len(ids) - n + 1
    out = ids[:m] * _PLACES[0]
    for k in range(1, n):
        out += ids[k : m + k] * _PLACES[k]
    return mixed(out)
