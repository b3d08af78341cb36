"""Problem 5: evaluation items leaking into documents, by size-partitioned MinHash containment search.

A leak is a run of at least ``run`` (12) consecutive words of an item that stands consecutively in a document. Each such
run of an item is a small query set: its ``run - k + 1`` word shingles of ``k`` (5) words. Items are partitioned by the
number of their shingles. An item of at most u shingles may leak by a containment of only (run - k + 1) / u, which no
signature of a whole document, nor of a whole item, finds with certainty; so both are cut into all windows of the query
sets' size, and a leak is a window of the one that equals a window of the other, with equal MinHashes: none is missed.
A partition's band has as many MinHash rows as its containment asks for: the longer the items, the more windows they have
and the smaller the part that must leak, so that one MinHash in common says less (``PARTITIONS``).

Documents probe partitions, not items: a Bloom filter of fixed size (``bits``) holds the bands of all partitions; only
windows with a band in it go on, each to the partitions it can reach. They are verified there by their exact words.
The plan is the same for any number of items; more of them only fill the filter.

Cases: null and empty texts leak nothing, nor do items of fewer than ``run`` words. Repeated rows and repeated passages
give one row. Empty tables give an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.words import MULT, Words, chunks, mix, run_hashes, words_of
from garimpo.plans.materialize import materialize, spread


@lru_cache(maxsize=1)
def _marks() -> re.Pattern:
    ranges, start = [], None
    for cp in range(0x300, sys.maxunicode + 2):
        is_mark = cp <= sys.maxunicode and unicodedata.category(chr(cp))[0] == "M"
        if is_mark and start is None:
            start = cp
        elif not is_mark and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return re.compile(f"[{''.join(ranges)}]+")


def without_accents(text: str) -> str:
    """The text decomposed, with combining marks dropped."""
    return text if text.isascii() else _marks().sub("", unicodedata.normalize("NFD", text))


def plain_words(text: str) -> list[str]:
    """Lower-case words without accents."""
    return words_of(without_accents(text))


#: Partitions by the number of an item's shingles: (most shingles, MinHash rows of the band).
PARTITIONS = ((16, 1), (64, 2), (None, 3))
PROBES = 4  # bits of the filter for each band
_SEEDS = (np.uint64(0), np.uint64(0x9E6C63D0676A9A99), np.uint64(0xC2B2AE3D27D4EB4F))


def partition_of(shingles: int) -> int:
    """Number of the partition of an item."""
    return next(i for i, (most, _) in enumerate(PARTITIONS) if most is None or shingles <= most)


def _minima(s: np.ndarray, size: int) -> np.ndarray:
    """Least value of each ``size`` consecutive ones, by doubling."""
    n, span = len(s) - size + 1, 1
    while 2 * span <= size:
        s = np.minimum(s[: len(s) - span], s[span:])
        span *= 2
    return np.minimum(s[:n], s[size - span : size - span + n])


def bands(h: np.ndarray, run: int, k: int, wanted: tuple[int, ...] | None = None) -> dict[int, np.ndarray]:
    """By partition the band of each window of ``run`` words, from the hashes of the words; empty if there are fewer."""
    wanted = tuple(range(len(PARTITIONS))) if wanted is None else wanted
    if len(h) < run or not wanted:
        return {p: np.empty(0, np.uint64) for p in wanted}
    s = run_hashes(h, k)
    rows, out = [], {}
    for p in sorted(wanted):
        while len(rows) < PARTITIONS[p][1]:
            rows.append(_minima(mix(s ^ _SEEDS[len(rows)]) if rows else s, run - k + 1))
        band = np.full(len(rows[0]), np.uint64(p + 1))
        for m in rows[: PARTITIONS[p][1]]:
            band = mix(band * MULT + m)
        out[p] = band
    return out


def item_windows(items: DataFrame, run: int = 12, k: int = 5) -> DataFrame:
    """(part, band, words, item_id) of each distinct window of each item; a written table."""

    def cut(batches):
        for b in batches:
            rows = set()
            for item, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = plain_words(t or "")
                if len(w) < run:
                    continue
                p = partition_of(len(w) - k + 1)
                for i, m in enumerate(bands(Words([" ".join(w)]).hashes, run, k, (p,))[p].view(np.int64).tolist()):
                    rows.add((p, m, " ".join(w[i : i + run]), item))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.string(), pa.int64()))], ["part", "band", "words", "item_id"])

    return materialize(items.select("item_id", "text").mapInArrow(cut, "part int, band bigint, words string, item_id bigint").distinct(), "items")


def _probes(band: np.ndarray, bits: int) -> list[np.ndarray]:
    """Positions of each band in a filter of 2 ** ``bits`` bits."""
    other = mix(band) | np.uint64(1)
    return [(band + np.uint64(i) * other) >> np.uint64(64 - bits) for i in range(PROBES)]


def band_filter(index: DataFrame, bits: int) -> np.ndarray:
    """Bloom filter of the items' bands, as 64-bit words. Tasks set its bits; at most 2 ** (bits - 6) words come together."""

    def fill(batches):
        for b in batches:
            at = np.concatenate(_probes(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
            word, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            order = np.argsort(word)
            first = np.flatnonzero(np.r_[True, np.diff(word[order]) > 0]) if len(at) else np.empty(0, np.int64)
            value = np.bitwise_or.reduceat(bit[order], first) if len(at) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word[order][first].astype(np.int32)), pa.array(value.view(np.int64))], ["word", "value"])

    got = index.select("band").mapInArrow(fill, "word int, value bigint").groupBy("word").agg(F.expr("bit_or(value)").alias("value")).toPandas()
    out = np.zeros(1 << max(bits - 6, 0), np.uint64)
    out[got["word"].to_numpy(np.int64)] = got["value"].to_numpy(np.int64).view(np.uint64)
    return out


def _may_hold(words: np.ndarray, band: np.ndarray, bits: int) -> np.ndarray:
    ok = np.ones(len(band), bool)
    for at in _probes(band, bits):
        ok &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


def window_bands(docs: DataFrame, index: DataFrame, run: int = 12, k: int = 5, bits: int = 26) -> DataFrame:
    """(doc_id, part, band, words) of each window of each document that may stand in an item of a partition."""
    sent = docs.sparkSession.sparkContext.broadcast(band_filter(index, bits))  # 8 MB at any size
    parts = tuple(sorted(r["part"] for r in index.select("part").distinct().collect()))  # one row a partition

    def cut(batches):
        known = sent.value
        for b in batches:
            at, part, band, words = [], [], [], []
            for first, texts in chunks(b.column(1).to_pylist()):
                w = Words([without_accents(t) if t else "" for t in texts])
                for p, m in bands(w.hashes, run, k, parts).items():
                    if not len(m):
                        continue
                    # neighbouring windows mostly share their band: look up each only once
                    new = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
                    hit = np.flatnonzero(np.repeat(_may_hold(known, m[new], bits), np.diff(np.r_[new, len(m)])))
                    owner = np.searchsorted(w.bounds, hit, side="right") - 1
                    inside = w.bounds[owner + 1] - hit >= run  # the window lies within one text
                    hit, owner = hit[inside], owner[inside]
                    at.append(first + owner)
                    part.append(np.full(len(hit), p, np.int32))
                    band.append(m[hit].view(np.int64))
                    words += [" ".join(w.word(i) for i in range(q, q + run)) for q in hit.tolist()]
            cols = [np.concatenate(x) if x else np.empty(0, t) for x, t in ((at, np.int64), (part, np.int32), (band, np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0])), pa.array(cols[1]), pa.array(cols[2]), pa.array(words, pa.string())], ["doc_id", "part", "band", "words"])

    return spread(docs.select("doc_id", "text")).mapInArrow(cut, "doc_id bigint, part int, band bigint, words string")


def leaked_windows(docs: DataFrame, index: DataFrame, run: int = 12, k: int = 5, bits: int = 26) -> DataFrame:
    """(doc_id, item_id, part) of each leaked window of each document."""
    return window_bands(docs, index, run, k, bits).join(index, ["part", "band", "words"]).select("doc_id", "item_id", "part")


def leaks(docs: DataFrame, items: DataFrame, run: int = 12, k: int = 5) -> DataFrame:
    """(doc_id, item_id): documents that hold a run of at least ``run`` words of the item."""
    return leaked_windows(docs, item_windows(items, run, k), run, k).select("doc_id", "item_id").distinct()


def leaked_items(docs: DataFrame, items: DataFrame, run: int = 12, k: int = 5) -> DataFrame:
    """(item_id, n_documents): in how many documents each item has leaked, 0 included."""
    n = leaks(docs, items, run, k).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return items.select("item_id").distinct().join(n, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_documents"))
