"""Problem 4: exact similarity self-join of word-run sets, with skipping on set relations.

A record is the set of its distinct runs of ``run`` consecutive words; two records match if the Jaccard similarity of
their sets reaches ``threshold``. Equal sets are one class. The join is exact and skips on two levels:

* *index level*: runs are ordered by rarity; only the first few runs of a set (enough that two matching sets must share
  one) are listed. A run's list consists of blocks of entries that have the same set size and the same position of the
  run. The size bound and the position bound hold for a whole block, so pairs of blocks are skipped without looking at
  their entries. A list of more than ``most`` entries is not paired at all: two matching classes share at least two runs,
  so it is split by the second one, over all runs that may follow. What is still longer (many sets that share the same two
  runs) is cut into parts of ``most`` entries, and each two parts are a task's work of their own.
* *answer level*: candidates are brought together in neighbourhoods around a *leader* set. Each member of a neighbourhood
  is compared with the leader once and kept as its difference ``d`` from it. A pair's answer follows from the two members'
  answers: ``|a ^ b|`` lies between ``||d(a)| - |d(b)||`` and ``|d(a)| + |d(b)|``, which settles most pairs, and is
  ``|d(a)| + |d(b)| - 2 |d(a) & d(b)|`` otherwise.

A class is named by 63 bits of a hash of its set. Cases: null, empty and short texts (fewer than ``min_words`` words)
have no set and appear in no pair and no group. Equal texts match whatever their length above ``min_words``. A repeated
``seq`` counts once. Empty tables give empty results. Columns other than those named are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.words import Words, chunks, effective_text, run_hashes
from garimpo.plans.materialize import materialize, spread

SKETCH_BITS = 18
LOW56 = np.uint64((1 << 56) - 1)


def _sets(texts: list, run: int, min_words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(position, sorted distinct hashes of the runs) of each text of at least ``min_words`` words."""
    for at, part in chunks(texts):
        w = Words(part)
        runs = run_hashes(w.hashes, run)
        for i in np.flatnonzero(np.diff(w.bounds) >= max(min_words, run)):
            yield at + int(i), np.unique(runs[w.bounds[i] : w.bounds[i + 1] - run + 1])


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _run_counts(docs: DataFrame, run: int, min_words: int) -> np.ndarray:
    """How many records hold a run, per bucket of run hashes: a table of fixed size, counted over all records.

    It only orders the runs by rarity; any order gives the same pairs.
    """

    def count(batches):
        n = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            got = [s for _, s in _sets(b.column(0).to_pylist(), run, min_words)]
            if got:
                n += np.bincount(_bucket(np.concatenate(got)), minlength=len(n))
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n[k])], ["bucket", "n"])

    got = docs.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def _levels(counts: np.ndarray) -> np.ndarray:
    """Rarity of each bucket on a scale of 0 (rarest) to 255."""
    return np.minimum(255, np.rint(8 * np.log2(1.0 + counts))).astype(np.uint64)


def _ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set's runs as keys that sort by rarity: level in the top byte, hash below."""
    return np.sort((levels[_bucket(s)] << np.uint64(56)) | (s & LOW56))


def _needed(a, b, t: float):
    """Least overlap of sets of sizes ``a`` and ``b`` with similarity ``t``."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


def signatures(docs: DataFrame, run: int = 5, min_words: int = 30, threshold: float = 0.8) -> DataFrame:
    """(seq, class, size, prefix) of each record of ``docs(seq, text)`` that has a set; a written table.

    ``prefix`` holds the runs that are listed, and one more. Of copies met by one task, only the first has it: a group
    of copies is listed once a task at most.
    """
    levels = docs.sparkSession.sparkContext.broadcast(_levels(_run_counts(docs, run, min_words)))

    def sign(batches):
        met = set()
        for b in batches:
            keys, sizes, pref, at, first = [], [], [], [], []
            for i, s in _sets(b.column(1).to_pylist(), run, min_words):
                key = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little") >> 1
                at.append(i)
                keys.append(key)
                sizes.append(len(s))
                first.append(key not in met)
                if first[-1]:
                    met.add(key)
                    o = _ordered(s, levels.value)
                    pref.append(o[: len(o) - math.ceil(threshold * len(o) - 1e-9) + 2])
                else:
                    pref.append(np.empty(0, np.uint64))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pref])]).astype(np.int32), mask=np.r_[~np.array(first, bool), False])
            flat = np.concatenate(pref).view(np.int64) if pref else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["seq", "class", "size", "prefix"]
            )

    return materialize(docs.select("seq", "text").mapInArrow(sign, "seq bigint, class bigint, size int, prefix array<bigint>"), "signatures")


def _block_pairs(key: np.ndarray, size: np.ndarray, pos: np.ndarray, threshold: float):
    """(first block, second block) of all pairs of blocks of one list that may hold matches, a block with itself included.

    Entries arrive sorted by (key, size, pos); a block's bounds are those of each of its entries.
    """
    n = len(key)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lens = np.diff(np.r_[start, n])
    end = np.repeat(start + lens, lens)
    # smaller sets only need to be found by their shorter index prefix
    active = np.flatnonzero(pos <= size - _needed(size, size, threshold))
    k = 0
    while len(active):
        j = active + k
        keep = j < end[active]
        keep[keep] = size[active[keep]] >= threshold * size[j[keep]] - 1e-9  # sizes rise: the rest of the list falls away too
        active, j = active[keep], j[keep]
        ok = np.minimum(size[active] - pos[active], size[j] - pos[j]) >= _needed(size[active], size[j], threshold)
        if ok.any():
            yield active[ok], j[ok]
        k += 1


def _pairs_of_lists(cols: list[np.ndarray], threshold: float, most_out: int = 500_000):
    """Candidate pairs (a < b) of lists whose entries (key, class, size, pos) are sorted by key, size and pos."""
    key, cls, size, pos = cols
    if not len(key):
        return
    new = np.r_[True, (key[1:] != key[:-1]) | (size[1:] != size[:-1]) | (pos[1:] != pos[:-1])]
    at = np.flatnonzero(new)
    length = np.diff(np.r_[at, len(key)])
    out, held = [], 0
    for i, j in _block_pairs(key[at], size[at], pos[at], threshold):
        total = length[i] * length[j]
        for lo, hi in _spans(total, most_out):
            m, each = total[lo:hi], length[j[lo:hi]]
            if not m.sum():
                continue
            inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            wide = np.repeat(each, m)
            x, y = cls[np.repeat(at[i[lo:hi]], m) + inner // wide], cls[np.repeat(at[j[lo:hi]], m) + inner % wide]
            ok = np.where(np.repeat(i[lo:hi] == j[lo:hi], m), inner // wide < inner % wide, True) & (x != y)
            out.append(np.stack([np.minimum(x, y)[ok], np.maximum(x, y)[ok]]))
            held += out[-1].shape[1]
            if held > most_out:
                yield _distinct(list(np.concatenate(out, axis=1)))
                out, held = [], 0
    if held:
        yield _distinct(list(np.concatenate(out, axis=1)))


def _spans(total: np.ndarray, most: int):
    """Stretches whose sums stay near ``most``."""
    if not len(total):
        return
    cut = np.flatnonzero(np.diff(np.cumsum(total) // most, prepend=0)) + 1
    edges = np.unique(np.r_[0, cut, len(total)])
    yield from zip(edges[:-1].tolist(), edges[1:].tolist())


def _candidates(threshold: float, most: int | None):
    """Pairs of each list. Lists arrive sorted by (key, part), size and position; one of more than ``most`` distinct
    entries gives its key (and no second end) instead, and what follows of it is not kept."""

    def run(batches):
        rest = None
        hot = None  # key of the long list being passed over

        def emit(p):
            return pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], ["a", "b"])

        def settle(cols):
            """Pairs of whole lists."""
            cols = _distinct(cols)
            longs = np.empty(0, np.int64)
            if most is not None and len(cols[0]):
                keys, n = np.unique(cols[0], return_counts=True)
                longs = keys[n > most]
                if len(longs):
                    keep = ~np.isin(cols[0], longs)
                    cols = [c[keep] for c in cols]
            for p in _pairs_of_lists(cols, threshold):
                yield emit(p)
            if len(longs):
                yield pa.RecordBatch.from_arrays([pa.array(longs), pa.nulls(len(longs), pa.int64())], ["a", "b"])

        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if not len(cols[0]):
                continue
            if hot is not None:
                first = int(np.searchsorted(cols[0], hot, side="right"))
                cols = [c[first:] for c in cols]
                if not len(cols[0]):
                    continue
                hot = None
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last list may go on
            yield from settle([c[:cut] for c in cols])
            rest = _distinct([c[cut:] for c in cols])
            if most is not None and len(rest[0]) > most:
                hot = rest[0][0]
                yield pa.RecordBatch.from_arrays([pa.array([hot]), pa.nulls(1, pa.int64())], ["a", "b"])
                rest = None
        if rest is not None:
            yield from settle(rest)

    return run


def _distinct(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Rows without repeats, sorted by their columns; entries (key, class, size, pos) by key, size and pos."""
    if len(cols[0]) < 2:
        return cols
    order = np.lexsort((cols[1], cols[3], cols[2], cols[0]) if len(cols) == 4 else cols[::-1])
    cols = [c[order] for c in cols]
    new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])]
    return [c[new] for c in cols]


_ENTRY = "a bigint, b bigint"


def _listing(sigs: DataFrame, threshold: float) -> DataFrame:
    """(tok, class, size, pos) of the listed runs; what a prefix holds beyond them is not listed."""
    n = F.least(F.size("prefix"), F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - F.lit(1e-9)).cast("int") + 1)
    return sigs.filter("prefix is not null").select(F.posexplode(F.slice("prefix", F.lit(1), n)).alias("pos", "tok"), "class", "size").select(
        "tok", "class", F.col("size").cast("bigint").alias("size"), F.col("pos").cast("bigint").alias("pos")
    )


def candidate_pairs(sigs: DataFrame, threshold: float = 0.8, most: int = 1024) -> DataFrame:
    """Distinct pairs (a < b) of classes that may match; a written table."""
    parts = int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = _listing(sigs, threshold)
    split = threshold > 0.5  # else two matching classes may share a single run
    found = materialize(lists.repartition(parts, "tok").sortWithinPartitions("tok", "size", "pos").mapInArrow(_candidates(threshold, most), _ENTRY), "found")
    pairs = found.filter("b is not null")
    long = found.filter("b is null").select(F.col("a").alias("tok")).distinct()
    if long.limit(1).count():
        hits = lists.join(long, "tok").select("class", "size", "pos", "tok")
        if split:
            # the entry once for each run that may be the second shared one
            tails = sigs.filter("prefix is not null").groupBy("class").agg(F.first("prefix").alias("prefix"))
            after = F.explode(F.slice("prefix", (F.col("pos") + 2).cast("int"), F.size("prefix")))
            second = hits.distinct().join(tails, "class").select("tok", after.alias("second"), "class", "size", "pos").select(F.xxhash64("tok", "second").alias("tok"), "class", "size", "pos")
            # a repeated second run keeps the position of the first, which bounds what can still be shared
            hits = materialize(second, "seconds")
            again = hits.repartition(parts, "tok").sortWithinPartitions("tok", "size", "pos").mapInArrow(_candidates(threshold, most), _ENTRY)
            again = materialize(again, "found")
            pairs = pairs.unionByName(again.filter("b is not null"))
            long = again.filter("b is null").select(F.col("a").alias("tok")).distinct()
            hits = hits.join(long, "tok")
        # each two parts of a list are put together somewhere; parts are cut by the class
        hits = hits.distinct()
        n = hits.groupBy("tok").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("n"))
        part = hits.join(n, "tok").withColumn("p", F.pmod(F.xxhash64("class"), F.col("n")).cast("int"))
        spread_out = part.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
            F.xxhash64("tok", F.least("p", "q"), F.greatest("p", "q")).alias("tok"), "class", "size", "pos"
        )
        pairs = pairs.unionByName(spread_out.repartition(parts, "tok").sortWithinPartitions("tok", "size", "pos").mapInArrow(_candidates(threshold, None), _ENTRY))
    return materialize(pairs.distinct(), "candidates")


def _verify_one(ids: np.ndarray, sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float, most: int = 2_000_000):
    """Matching pairs of one neighbourhood, whose first set is the leader's."""
    leader = sets[0]
    diff = [np.setxor1d(leader, s, assume_unique=True) for s in sets]
    sizes, n = np.array([len(s) for s in sets]), np.array([len(d) for d in diff])
    ia, ib = np.searchsorted(ids, a), np.searchsorted(ids, b)
    most_apart = sizes[ia] + sizes[ib] - 2 * _needed(sizes[ia], sizes[ib], threshold)
    keep = n[ia] + n[ib] <= most_apart
    open_ = np.flatnonzero(~keep & (np.abs(n[ia] - n[ib]) <= most_apart))
    for lo, hi in _spans(n[ia[open_]] + n[ib[open_]], most):
        k = open_[lo:hi]
        if not len(k):
            continue
        # what two differences share occurs twice under the pair's number
        both = np.concatenate([x for p in k.tolist() for x in (diff[ia[p]], diff[ib[p]])])
        pair = np.repeat(np.arange(len(k)), n[ia[k]] + n[ib[k]])
        order = np.lexsort((both, pair))
        both, pair = both[order], pair[order]
        twice = (both[1:] == both[:-1]) & (pair[1:] == pair[:-1])
        shared = np.bincount(pair[1:][twice], minlength=len(k))
        keep[k] = n[ia[k]] + n[ib[k]] - 2 * shared <= most_apart[k]
    return a[keep], b[keep]


def _verify(run: int, min_words: int, threshold: float):
    """Neighbourhoods arrive one after the other, each with its texts first (leader ahead) and then its pairs."""

    def run_(batches):
        key, ids, sets, a, b = None, [], [], [], []
        out = ([], [])

        def close():
            if a:
                for o, x in zip(out, _verify_one(np.array(ids, np.int64), sets, np.array(a, np.int64), np.array(b, np.int64), threshold)):
                    o.append(x)

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["a", "b"])

        for rows in batches:
            lead, salt, end, first, second = (rows.column(i).to_pylist() for i in range(5))
            texts = rows.column(5).to_pylist()
            own = dict(_sets(texts, run, min_words))
            for i, k in enumerate(zip(lead, salt)):
                if k != key:
                    close()
                    key, ids, sets, a, b = k, [], [], [], []
                if end[i]:
                    a.append(first[i])
                    b.append(second[i])
                elif i in own:
                    ids.append(first[i])
                    sets.append(own[i])
            if sum(map(len, out[0])) > 200_000:
                yield batch()
                out = ([], [])
        close()
        if out[0]:
            yield batch()

    return run_


def class_links(docs: DataFrame, sigs: DataFrame, run: int = 5, min_words: int = 30, threshold: float = 0.8, most: int = 20_000) -> DataFrame:
    """(a, b): all matching pairs of classes, a < b; a written table.

    A neighbourhood's leader is its smallest class. One with more than ``most`` candidate pairs is split over several
    tasks, each with the texts it needs.
    """
    pairs = candidate_pairs(sigs, threshold)
    ends = pairs.select(F.col("a").alias("id"), F.col("a").alias("near")).union(pairs.select(F.col("b"), F.col("a")))
    leads = ends.groupBy("id").agg(F.min("near").alias("lead"))
    led = pairs.join(leads.withColumnsRenamed({"id": "a", "lead": "la"}), "a").join(leads.withColumnsRenamed({"id": "b", "lead": "lb"}), "b").select("a", "b", F.least("la", "lb").alias("lead"))
    n = led.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).alias("splits"))
    routed = materialize(led.join(n, "lead").select("a", "b", "lead", F.pmod(F.xxhash64("a", "b"), "splits").cast("int").alias("salt")), "routed")
    wanted = routed.select("lead", "salt", F.explode(F.array("a", "b", "lead")).alias("id")).distinct()
    # one text of each wanted class
    one = sigs.groupBy("class").agg(F.min("seq").alias("seq")).withColumnRenamed("class", "id")
    wanted = wanted.join(one, "id")
    held = docs.select("seq", "text").join(wanted.select("seq").distinct(), "seq", "left_semi").dropDuplicates(["seq"])
    texts = wanted.join(held, "seq").select("lead", "salt", F.lit(False).alias("is_pair"), F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), "text")
    both = texts.unionByName(routed.select("lead", "salt", F.lit(True).alias("is_pair"), "a", "b", F.lit(None).cast("string").alias("text")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(parts, "lead", "salt").sortWithinPartitions("lead", "salt", "is_pair", "a")
    links = ordered.mapInArrow(_verify(run, min_words, threshold), "a bigint, b bigint")
    return materialize(links, "links")


def _docs(raw: DataFrame) -> DataFrame:
    return spread(raw.select("seq", effective_text(raw).alias("text")))


def _members(links: DataFrame, member: DataFrame, end: str, out: str, most: int) -> DataFrame:
    """``links`` with the class in column ``end`` replaced by each of its records, as ``out``.

    A class of more than ``most`` records is cut into parts, each joined on its own.
    """
    n = member.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("n"))
    cut = member.join(n, "class").select(F.col("class").alias(end), F.pmod(F.xxhash64("seq"), F.col("n")).cast("int").alias("part"), F.col("seq").alias(out))
    wide = links.join(n.withColumnRenamed("class", end), end).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    return wide.join(cut, [end, "part"]).drop(end, "part")


def near_duplicate_pairs(raw: DataFrame, run: int = 5, min_words: int = 30, threshold: float = 0.8, most: int = 1000) -> DataFrame:
    """(seq_a, seq_b), seq_a < seq_b: every pair of records whose sets of word runs have similarity ``threshold`` or more.

    Pairs are listed from the links of classes, and of each class with itself if it has several records.
    """
    docs = _docs(raw)
    sigs = signatures(docs, run, min_words, threshold)
    member = materialize(sigs.select("class", "seq").distinct(), "members")
    links = class_links(docs, sigs, run, min_words, threshold).select("a", "b")
    own = member.groupBy("class").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("class").alias("a"), F.col("class").alias("b"))
    both = links.withColumn("same", F.lit(False)).unionByName(own.withColumn("same", F.lit(True)))
    wide = _members(_members(both, member, "a", "x", most), member, "b", "y", most)
    return wide.filter("not same or x < y").select(F.least("x", "y").alias("seq_a"), F.greatest("x", "y").alias("seq_b"))


def near_duplicate_groups(raw: DataFrame, run: int = 5, min_words: int = 30, threshold: float = 0.8, rounds: int = 60) -> DataFrame:
    """(seq, class_id, group_id, links): each record with a set, its class of equal sets, its group and its class's links.

    A group is a connected component of matching classes; it and a class are named by their smallest ``seq``. Components
    are found by repeated label lowering and pointer jumping over written tables, in a number of rounds logarithmic in
    the longest chain.
    """
    docs = _docs(raw)
    sigs = signatures(docs, run, min_words, threshold)
    links = class_links(docs, sigs, run, min_words, threshold)
    name = materialize(sigs.groupBy("class").agg(F.min("seq").alias("class_id")), "names")
    named = links.join(name.withColumnsRenamed({"class": "a", "class_id": "x"}), "a").join(name.withColumnsRenamed({"class": "b", "class_id": "y"}), "b")
    named = materialize(named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "links")
    group = components(named, rounds)
    both = named.select(F.col("a").alias("class_id")).union(named.select("b")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return (
        sigs.select("class", "seq").distinct().join(name, "class").select("seq", "class_id")
        .join(group.withColumnsRenamed({"id": "class_id", "component": "group_id"}), "class_id", "left")
        .join(both, "class_id", "left")
        .select("seq", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of each end of ``edges(a, b)``: alternating large-star and small-star steps until nothing changes."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    before = None
    for _ in range(rounds):
        # large star: every neighbour above u points to the least of u and its neighbours
        sym = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its neighbours below point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), F.col("m").alias("m")))).alias("e")).select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()
        now = materialize(small, "edges")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.lit(0)).alias("h")).first()
        if before == tuple(state):
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return nodes.join(now.withColumnsRenamed({"u": "id", "v": "component"}), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
