"""Exact duplicates, MinHash-LSH near-duplicates with greedy resolution, and held-out leakage.

Signatures are computed in Arrow batches: distinct word n-grams, 64-bit BLAKE2b hashes, ``a * h + b`` modulo 2^64 with
coefficients from NumPy's ``RandomState(seed)``, column-wise unsigned minimum; stored as signed 64-bit patterns. Equal
signatures are one class before any band join, so groups of copies cost one row. Null and empty texts have no signature:
they are never duplicates and never inserted.
"""

from __future__ import annotations

import hashlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions.text import normalize
from garimpo.plans.materialize import materialize


def coefficients(num_perm: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of the permutations."""
    rng = np.random.RandomState(seed)
    top = np.iinfo(np.int64).max
    a = rng.randint(1, top, size=(1, num_perm), dtype=np.int64).astype(np.uint64)
    b = rng.randint(0, top, size=(1, num_perm), dtype=np.int64).astype(np.uint64)
    return a | np.uint64(1), b


def signature(tokens: list[str], num_perm: int = 128, seed: int = 42) -> np.ndarray:
    """MinHash of a token list; zeros without tokens."""
    if not tokens:
        return np.zeros(num_perm, np.uint64)
    a, b = coefficients(num_perm, seed)
    h = np.array([int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for t in set(tokens)], np.uint64)
    out = np.full(num_perm, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 4096):
        out = np.minimum(out, (h[i : i + 4096, None] * a + b).min(axis=0))
    return out


def older_signature(text: str, size: int = 5, num_perm: int = 64, seed: int = 42) -> np.ndarray:
    """The older MinHash: xxHash-64 of the character n-grams of the normalized text, ``a * h + b`` modulo 2^64, then modulo 2^61 - 1."""
    import xxhash

    plain = " ".join(text.lower().split())
    if not plain:
        return np.zeros(num_perm, np.uint64)
    prime = (1 << 61) - 1
    rng = np.random.RandomState(seed)  # the order of these two draws is fixed
    a = rng.randint(1, prime, size=(num_perm, 1), dtype=np.uint64)
    b = rng.randint(0, prime, size=(num_perm, 1), dtype=np.uint64)
    grams = {plain[i : i + size] for i in range(max(1, len(plain) - size + 1))}
    h = np.fromiter((xxhash.xxh64_intdigest(g.encode()) for g in grams), np.uint64, len(grams))
    out = np.full(num_perm, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 4096):
        out = np.minimum(out, ((a * h[i : i + 4096] + b) % np.uint64(prime)).min(axis=1))
    return out


def older_signatures(docs: DataFrame, size: int = 5, num_perm: int = 64, seed: int = 42) -> DataFrame:
    """(seq, signature) of ``docs(seq, text)`` by ``older_signature``; texts without words have none."""

    def sign(batches):
        for b in batches:
            at, sigs = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t and t.strip():
                    at.append(i)
                    sigs.append(older_signature(t, size, num_perm, seed).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(sigs, pa.list_(pa.int64()))], ["seq", "signature"])

    return docs.select("seq", "text").mapInArrow(sign, "seq bigint, signature array<bigint>")


def shingles(text: str, n: int) -> list[str]:
    w = text.split()
    return w if len(w) < n else [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


def signatures(docs: DataFrame, num_perm: int = 128, seed: int = 42, n: int = 5) -> DataFrame:
    """(seq, signature) of each document of ``docs(seq, text)`` that has words."""

    def sign(batches):
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                tokens = shingles(t, n) if t else []
                if tokens:
                    at.append(i)
                    out.append(signature(tokens, num_perm, seed).view(np.int64))
            flat = pa.array(np.concatenate(out) if out else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * num_perm, pa.int32()), flat)], ["seq", "signature"])

    return docs.select("seq", "text").mapInArrow(sign, "seq bigint, signature array<bigint>")


def distinct_signatures(sigs: DataFrame) -> DataFrame:
    """(seq, signature): the first document of each signature; a written table."""
    return materialize(sigs.groupBy("signature").agg(F.min("seq").alias("seq")).select("seq", "signature"), "signatures")


def band_keys(sig: Column, num_perm: int, rows: int) -> Column:
    """Array of the bands' keys; trailing rows that fill no band are dropped."""
    return F.transform(F.sequence(F.lit(0), F.lit(num_perm // rows - 1)), lambda i: F.xxhash64(i, F.slice(sig, i * rows + 1, rows)))


def signature_similarity(a: Column, b: Column) -> Column:
    """Share of equal positions."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def _bands(sigs: DataFrame, num_perm: int, rows: int) -> DataFrame:
    return sigs.select("seq", F.explode(band_keys(F.col("signature"), num_perm, rows)).alias("key"))


def band_pairs(left: DataFrame, right: DataFrame, most: int = 1000) -> DataFrame:
    """(a, b): all pairs of a row of ``left(seq, key)`` and one of ``right(seq, key)`` with the same key; repeats included.

    Rows of a band that is longer than ``most`` on the left are cut into parts; each part meets the whole right side of
    the band as a task's work of its own, so that no band's pairs are made in one place.
    """
    n = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", F.ceil(F.col("n") / F.lit(most)).cast("int").alias("parts"))
    cut = left.join(n, "key").select(F.col("seq").alias("a"), "key", F.pmod(F.xxhash64("seq"), F.col("parts")).cast("int").alias("part"))
    wide = right.join(n, "key").select(F.col("seq").alias("b"), "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return cut.join(wide, ["key", "part"]).select("a", "b")


def candidates(sigs: DataFrame, num_perm: int = 128, rows: int = 4, most: int = 1000) -> DataFrame:
    """(a, b), a < b: documents that share a band, each pair once."""
    keys = materialize(_bands(sigs, num_perm, rows), "bands")
    shared = keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "key", "left_semi")
    return band_pairs(shared, shared, most).filter("a < b").distinct()


def similar_pairs(sigs: DataFrame, threshold: float = 0.8, num_perm: int = 128, rows: int = 4) -> DataFrame:
    """(a, b, similarity) of the representatives of distinct signatures whose similarity reaches ``threshold``."""
    one = distinct_signatures(sigs)
    pairs = candidates(one, num_perm, rows)
    pairs = pairs.join(one.select(F.col("seq").alias("a"), F.col("signature").alias("sa")), "a").join(one.select(F.col("seq").alias("b"), F.col("signature").alias("sb")), "b")
    return pairs.select("a", "b", signature_similarity(F.col("sa"), F.col("sb")).alias("similarity")).filter(F.col("similarity") >= threshold)


def greedy_keep(nodes: DataFrame, edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """(seq): in order of ``seq``, each node that has no edge from an earlier kept one; ``edges(a, b)`` with a < b.

    Whole frontiers are decided at once: a node without an undecided earlier neighbour is kept, its later neighbours are
    dropped. The number of rounds is the longest chain of dependent decisions; each round works on the edges that are
    still open, in written tables. What was dropped is kept in tables that are merged as their number grows, so that the
    plan stays small however many rounds there are.
    """
    open_ = materialize(edges.select("a", "b"), "edges")
    dropped: list[DataFrame] = []

    def merged() -> DataFrame:
        out = dropped[0]
        for d in dropped[1:]:
            out = out.unionByName(d)
        return out

    for _ in range(rounds):
        if open_.isEmpty():
            break
        front = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        now = materialize(open_.join(front, "a", "left_semi").select("b").distinct(), "dropped")
        open_ = materialize(open_.join(now, "b", "left_anti").join(now.select(F.col("b").alias("a")), "a", "left_anti"), "edges")
        dropped.append(now)
        if len(dropped) == 16:
            dropped[:] = [materialize(merged(), "dropped")]
    else:
        raise RuntimeError(f"undecided after {rounds} rounds")
    return nodes.select("seq").join(merged().select(F.col("b").alias("seq")), "seq", "left_anti") if dropped else nodes.select("seq")


def greedy_dedup(docs: DataFrame, threshold: float = 0.8, num_perm: int = 128, rows: int = 4, seed: int = 42, n: int = 5) -> DataFrame:
    """The rows of ``docs(seq, text)`` that a sequential pass in order of ``seq`` would keep, with an index that never overflows."""
    sigs = materialize(signatures(docs, num_perm, seed, n), "all-signatures")
    one = distinct_signatures(sigs)
    keep = greedy_keep(one.select("seq"), similar_pairs(sigs, threshold, num_perm, rows))
    silent = docs.join(sigs.select("seq"), "seq", "left_anti").select("seq")
    return docs.join(keep.unionByName(silent), "seq", "left_semi")


def ring_keep(ordered: list[tuple[int, list[int]]], capacity: int) -> list[int]:
    """The ordered fold with an index of the last ``capacity`` kept documents.

    ``ordered`` holds (seq, earlier similar documents) in order of seq.
    """
    kept, last = [], Ring(capacity)
    for seq, earlier in ordered:
        if not any(j in last for j in earlier):
            kept.append(seq)
            last.add(seq)
    return kept


class Ring:
    """The last ``capacity`` numbers that were added."""

    def __init__(self, capacity: int):
        self.capacity, self.order, self.held = capacity, deque(), set()

    def add(self, seq: int) -> None:
        self.order.append(seq)
        self.held.add(seq)
        if len(self.order) > self.capacity:
            self.held.discard(self.order.popleft())

    def __contains__(self, seq: int) -> bool:
        return seq in self.held


def windowed_dedup(docs: DataFrame, capacity: int, threshold: float = 0.8, num_perm: int = 128, rows: int = 4, seed: int = 42, n: int = 5) -> DataFrame:
    """Like ``greedy_dedup``, but only the last ``capacity`` kept documents are compared with.

    What a document finds depends on how many were kept before it, so the decisions form one ordered fold. It runs in one
    task over the similar pairs and the sequence numbers only, streamed in order; it holds ``capacity`` numbers.
    """
    sigs = materialize(signatures(docs, num_perm, seed, n), "all-signatures")
    pairs = candidates(sigs, num_perm, rows)
    s = sigs.select(F.col("seq").alias("b"), F.col("signature").alias("sb"))
    pairs = pairs.join(sigs.select(F.col("seq").alias("a"), F.col("signature").alias("sa")), "a").join(s, "b").filter(signature_similarity(F.col("sa"), F.col("sb")) >= threshold).select("a", "b")
    rowed = sigs.select("seq", F.lit(-1).cast("bigint").alias("earlier")).unionByName(pairs.select(F.col("b").alias("seq"), F.col("a").alias("earlier")))

    def fold(batches):
        last = Ring(capacity)
        now, hit = None, False
        for b in batches:
            out = []
            for seq, earlier in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if seq != now:
                    if now is not None and not hit:
                        last.add(now)
                        out.append(now)
                    now, hit = seq, False
                hit |= earlier in last
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["seq"])
        if now is not None and not hit:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64())], ["seq"])

    keep = rowed.repartition(1).sortWithinPartitions("seq", "earlier").mapInArrow(fold, "seq bigint")
    silent = docs.join(sigs.select("seq"), "seq", "left_anti").select("seq")
    return docs.join(keep.unionByName(silent), "seq", "left_semi")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The first document, by ``seq``, of each normalized text."""
    first = docs.groupBy(F.sha2(normalize(F.col("text")), 256).alias("k")).agg(F.min("seq").alias("seq")).select("seq")
    return docs.join(first, "seq", "left_semi")


def held_out_leaks(train: DataFrame, val: DataFrame, threshold: float = 0.65, num_perm: int = 128, rows: int = 4, seed: int = 42, n: int = 5) -> DataFrame:
    """The rows of ``train(seq, text)`` whose normalized text is in ``val``, or whose signature is similar to one there."""
    key = F.sha2(normalize(F.col("text")), 256)
    exact = train.select("seq", key.alias("k")).join(val.select(key.alias("k")).distinct(), "k", "left_semi").select("seq")
    t, v = materialize(signatures(train, num_perm, seed, n), "train"), distinct_signatures(signatures(val, num_perm, seed, n))
    one = distinct_signatures(t)
    pairs = band_pairs(_bands(one, num_perm, rows), _bands(v, num_perm, rows)).distinct().withColumnsRenamed({"a": "seq", "b": "v"})
    pairs = pairs.join(one.withColumnRenamed("signature", "a"), "seq").join(v.select(F.col("seq").alias("v"), F.col("signature").alias("b")), "v")
    similar = pairs.filter(signature_similarity(F.col("a"), F.col("b")) >= threshold).select("a").distinct()
    near = t.join(similar.withColumnRenamed("a", "signature"), "signature", "left_semi").select("seq")
    return train.join(exact.unionByName(near), "seq", "left_semi")


def train_admission(train: DataFrame, val: DataFrame, threshold: float = 0.75, **options) -> DataFrame:
    """Training rows that are new: not in ``val``, not similar to it, and not a (near) duplicate of an earlier admitted row."""
    rest = train.join(held_out_leaks(train, val, threshold - 0.1, **options).select("seq"), "seq", "left_anti")
    return greedy_dedup(exact_dedup(rest), threshold, **options)

