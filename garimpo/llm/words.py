"""Words, effective text and source names, shared by the operators of this package."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MULT = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def word_pattern() -> re.Pattern:
    r"""``[\p{L}\p{Nd}]+``. Python's ``\w`` also holds letter numbers and other numbers, which are excluded here."""
    extra, start = [], None
    for cp in range(sys.maxunicode + 2):
        bad = cp <= sys.maxunicode and unicodedata.category(chr(cp)) in ("Nl", "No")
        if bad and start is None:
            start = cp
        elif not bad and start is not None:
            extra.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return re.compile(rf"[^\W_{''.join(extra)}]+")


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and decimal digits, lower-cased."""
    if "İ" in text:  # its lower case holds a combining mark, so lower-casing must come after cutting
        return [w.lower() for w in word_pattern().findall(text)]
    return word_pattern().findall(text.lower())


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finalizer on uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` consecutive words; empty if there are fewer words."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * MULT + h[i : len(h) - n + 1 + i]
    return mix(out)


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def effective_text(df: DataFrame) -> Column:
    """First of text, content, raw_content that is neither null nor empty; ``''`` if there is none."""
    cols = [F.nullif(F.col(c), F.lit("")) for c in ("text", "content", "raw_content") if has(df, c)]
    return F.coalesce(*cols, F.lit(""))


def source_name(df: DataFrame) -> Column:
    """``_source``, else ``source``, else ``unknown``, in its canonical spelling."""
    cols = [canonical(F.col(c)) for c in ("_source", "source") if has(df, c)]
    return F.coalesce(*cols, F.lit("unknown"))


def canonical(c: Column) -> Column:
    """Canonical spelling of a source name: trimmed, lower case, blanks and hyphens as underscores; null if empty."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_"), F.lit(""))


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """Whether each code point is a letter or a decimal digit."""
    out = np.zeros(sys.maxunicode + 1, bool)
    category = unicodedata.category
    out[[cp for cp in range(sys.maxunicode + 1) if (c := category(chr(cp)))[0] == "L" or c == "Nd"]] = True
    return out


_BASE, _INVERSE = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        n = 1 << max(20, (n - 1).bit_length())
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


class Words:
    """The words of several texts as 64-bit hashes, in order, found without a Python object for each word.

    ``hashes[bounds[i] : bounds[i + 1]]`` are those of text ``i``. A word's hash is the polynomial of its code points
    modulo 2^64, taken from running sums over all texts, and finalized.
    """

    __slots__ = ("hashes", "bounds", "code_points", "starts", "ends", "offsets")

    def __init__(self, texts: list):
        low = [(t.replace("İ", "ⱻ").lower() if "İ" in t else t.lower()) if t else "" for t in texts]
        sizes = np.fromiter(map(len, low), np.int64, len(low))
        self.offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        cp = self.code_points = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = word_characters()[cp]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.starts, self.ends = edge[::2], edge[1::2]
        lengths = self.ends - self.starts
        power, inverse = _power_tables(int(lengths.sum()) + 1)
        letters = mix(cp[inside].astype(np.uint64) + np.uint64(1))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * power[: len(letters)], dtype=np.uint64)])
        last = np.cumsum(lengths)
        first = last - lengths
        self.hashes = mix((total[last] - total[first]) * inverse[first] + lengths.astype(np.uint64))
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]

    def word(self, k: int) -> str:
        """The ``k``-th word of all texts."""
        return self.code_points[self.starts[k] : self.ends[k]].tobytes().decode("utf-32-le", "surrogatepass")


def chunks(texts: list, most: int = 400_000):
    """(first index, texts) of consecutive parts of about ``most`` characters; a longer text is a part of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= most:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def word_hash(word: str) -> int:
    """The hash of one lower-case word."""
    return int(Words([word]).hashes[0])
