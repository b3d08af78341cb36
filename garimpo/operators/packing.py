"""Token sequences: hashed tokens, budgets, shards, labels, cut offsets, packed windows, document positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from garimpo.functions.text import let, whitespace_words
from garimpo.plans.prefix import running_offset, running_rank

IGNORE = -100
MASK16 = 65535


def hashed_ids(text: Column, size: int = 50_000, first: int = 2) -> Column:
    """A stable id for each word: 32 bits of its MD5 modulo ``size``, from ``first`` on."""
    return F.transform(whitespace_words(text), lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("bigint") % size + first)


def valid_ids(ids: Column) -> Column:
    """Whether all ids fit in 32 unsigned bits."""
    return F.forall(ids, lambda x: (x >= 0) & (x <= 4294967295))


def token_budget(docs: DataFrame, order: str, n_ids: Column, max_tokens: int) -> DataFrame:
    """The documents written before ``max_tokens`` tokens (one end mark each) are reached: ``off``, ``written`` tokens each.

    The last one is cut so that the total is exact; with ``max_tokens`` of 0 or less there is none.
    """
    d = running_offset(docs, order, n_ids + 1).withColumn("_n", n_ids + 1)
    return d.filter(F.col("off") < max_tokens).withColumn("written", F.least(F.col("_n"), F.lit(max_tokens) - F.col("off"))).drop("_n")


def shard_parts(placed: DataFrame, size: int, first: int = 0, n: str = "written") -> DataFrame:
    """One row for each shard that a document's tokens ``[off, off + n)`` touch: ``shard_id``, ``shard_pos``, ``from``, ``n_part``."""
    last = F.floor((F.col("off") + F.col(n) - 1) / size)
    parts = placed.filter(F.col(n) > 0).withColumn("_k", F.explode(F.sequence(F.floor(F.col("off") / size), last)))
    begin = F.greatest(F.col("off"), F.col("_k") * size)
    end = F.least(F.col("off") + F.col(n), (F.col("_k") + 1) * size)
    return parts.select(*placed.columns, (F.col("_k") + first).alias("shard_id"), (begin - F.col("_k") * size).alias("shard_pos"), (begin - F.col("off")).alias("from"), (end - begin).alias("n_part")).drop("_k")


def shard_tokens(parts: DataFrame, ids: str, eos: int, source: str | None = None) -> DataFrame:
    """(shard_id, shard_pos, tokens): each part's tokens, the end mark being the last written one of its document; with its ``source`` if named."""
    body = F.concat(F.slice(F.col(ids), 1, (F.col("written") - 1).cast("int")), F.array(F.lit(eos).cast("bigint")))
    return parts.select("shard_id", "shard_pos", let(body, lambda b: F.slice(b, (F.col("from") + 1).cast("int"), F.col("n_part").cast("int"))).alias("tokens"), *([F.col(source).alias("source")] if source else []))


def sidecars(parts: DataFrame, source: str, eos: int, unit_len: int) -> DataFrame:
    """Sidecar of each shard: tokens in all and by source."""
    by = parts.groupBy("shard_id", source).agg(F.sum("n_part").alias("n"))
    return by.groupBy("shard_id").agg(
        F.sum("n").alias("n_tokens"), F.lit("uint32").alias("dtype"), F.lit(eos).cast("bigint").alias("eos_id"), F.lit(unit_len).alias("unit_len"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(source, "n")))).alias("sources")
    )


def next_labels(ids: Column, eos: int) -> Column:
    """Labels of all but the last token: the next token, ``IGNORE`` after an end mark."""
    return let(ids, lambda t: F.transform(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), lambda x, i: F.when(x == eos, F.lit(IGNORE).cast("bigint")).otherwise(F.get(t, i + 1))))


def cut_offsets(ids: Column, seq_len: int, eos: int) -> Column:
    """Sorted distinct cuts of a packed row: its ends, the multiples of ``seq_len``, and the place behind each end mark."""

    def cuts(t: Column) -> Column:
        ends = F.filter(F.transform(t, lambda x, i: F.when(x == eos, i + 1)), lambda v: v.isNotNull())
        return F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), F.size(t), F.lit(seq_len)), ends, F.array(F.size(t)))))

    return let(ids, lambda t: F.when(F.size(t) == 0, F.array(F.lit(0))).otherwise(cuts(t)))


def document_positions(ids: Column, eos: int) -> Column:
    """For each token, the number of its document in the row and its position there."""

    def spans(t: Column) -> Column:
        ends = F.filter(F.transform(t, lambda x, i: F.when(x == eos, i + 1)), lambda v: v.isNotNull())
        cuts = F.array_distinct(F.concat(F.array(F.lit(0)), ends, F.array(F.size(t))))
        return let(cuts, lambda c: F.flatten(F.transform(F.slice(c, 2, F.size(c)), lambda e, k: F.transform(F.sequence(F.lit(0), e - F.get(c, k) - 1), lambda p: F.struct(k.alias("doc"), p.alias("pos"))))))

    return let(ids, lambda t: F.when(F.size(t) == 0, F.array().cast("array<struct<doc:int,pos:int>>")).otherwise(spans(t)))


def shift_in_document(values: Column, docs: Column, fill: int) -> Column:
    """Each value replaced by its successor in the same document, by ``fill`` at the document's end."""
    return let(F.struct(values.alias("v"), docs.alias("d")), lambda s: F.transform(s["v"], lambda x, i: F.when(F.get(s["d"], i + 1) == F.get(s["d"], i), F.get(s["v"], i + 1)).otherwise(F.lit(fill).cast("bigint"))))


def causal_conv(values: Column, weights: list[float]) -> Column:
    """Weighted sum of each value and its predecessors: ``weights[i]`` for the one ``i`` places back, 0 before the start."""
    return let(values, lambda v: F.transform(v, lambda x, j: sum((F.lit(w) * F.coalesce(F.when(j >= i, F.get(v, F.when(j >= i, j - i).otherwise(0))), F.lit(0)) for i, w in enumerate(weights)), F.lit(0.0))))


def paired_sequence(ids: Column, eos: int, mask: int = MASK16) -> Column:
    """(input, target) of each token, an end mark appended if missing; the last target is masked."""
    whole = F.when(F.coalesce(F.get(ids, F.size(ids) - 1), F.lit(-1)) == eos, ids).otherwise(F.concat(ids, F.array(F.lit(eos).cast("bigint"))))
    return let(whole, lambda t: F.transform(t, lambda x, i: F.struct(x.alias("input"), F.coalesce(F.get(t, i + 1), F.lit(mask).cast("bigint")).alias("target"))))


def sft_mask(prompt: Column, response: Column, mask: int = MASK16) -> Column:
    """(input, target) of a prompt and its response: targets inside the prompt are masked."""
    whole = F.struct(F.concat(prompt, response).alias("t"), F.size(prompt).alias("p"))
    return let(whole, lambda s: F.transform(F.slice(s["t"], 1, F.greatest(F.size(s["t"]) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("input"), F.when(i < s["p"] - 1, F.lit(mask).cast("bigint")).otherwise(F.get(s["t"], i + 1)).alias("target"))))


def pad_or_cut(ids: Column, length: int, fill: int) -> Column:
    """The first ``length`` ids, filled up with ``fill``."""
    return let(ids, lambda t: F.concat(F.slice(t, 1, length), F.array_repeat(F.lit(fill).cast("bigint"), F.greatest(F.lit(length) - F.size(t), F.lit(0)))))


def chunk_indices(length: Column, chunk: int) -> Column:
    """0, 1, ... for the chunks of ``chunk`` tokens that a document of ``length`` tokens fills."""
    return F.when(length > 0, F.sequence(F.lit(0).cast("bigint"), F.ceil(length / chunk) - 1)).otherwise(F.array().cast("array<bigint>"))


def unit_grid(shards: DataFrame, unit_len: int) -> DataFrame:
    """(shard_id, n_units, first_unit): units of ``unit_len`` tokens with one more token behind; the tail is left out.

    One row a shard; the running sum over all of them is a window over the sidecars only.
    """
    n = F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / unit_len))
    w = W.orderBy("shard_id").rowsBetween(W.unboundedPreceding, -1)
    return shards.select("shard_id", n.cast("bigint").alias("n_units")).withColumn("first_unit", F.coalesce(F.sum("n_units").over(w), F.lit(0)))


def units(grid: DataFrame) -> DataFrame:
    """(shard_id, first_unit, unit): one row a unit, listed from its shard's row."""
    have = grid.filter("n_units > 0")
    return have.select("shard_id", "first_unit", F.explode(F.sequence("first_unit", F.col("first_unit") + F.col("n_units") - 1)).alias("unit"))


def windows_of_epochs(grid: DataFrame, seed: int, epochs: int, unit_len: int, seq_len: int, micro_batch: int) -> DataFrame:
    """(epoch, batch, row, shard_id, start): where each row of each batch begins; an epoch's leftover windows are dropped.

    The units of an epoch are permuted by the order of a keyed hash, computed on each row; their places are running
    counts over range partitions. Nothing is listed on the driver. Windows follow from the units by arithmetic.
    """
    if unit_len % seq_len:
        raise ValueError("unit_len must be a multiple of seq_len")
    per = unit_len // seq_len
    u = units(grid).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(epochs - 1).cast("bigint"))))
    u = u.withColumn("key", F.md5(F.concat(F.lit(f"{seed}-"), "epoch", F.lit(f"-{unit_len}:"), "unit")))
    placed = running_rank(u, "epoch", "key", "place")
    total = grid.agg(F.coalesce(F.sum("n_units"), F.lit(0)).alias("total"))
    w = placed.join(F.broadcast(total)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))  # a single row
    number = (F.col("place") - 1) * per + F.col("k")
    batch = F.floor(number / micro_batch)
    return w.filter(batch < F.floor(F.col("total") * per / micro_batch)).select(
        "epoch", batch.alias("batch"), (number % micro_batch).cast("bigint").alias("row"), "shard_id", ((F.col("unit") - F.col("first_unit")) * unit_len + F.col("k") * seq_len).alias("start")
    )


def unit_permutation(n_units: int, seed: int, epoch: int, unit_len: int) -> np.ndarray:
    """The order of the units in an epoch as NumPy's seeded generator draws it."""
    return np.random.default_rng([seed, epoch, unit_len]).permutation(n_units)


def windows_of_epoch(grid: DataFrame, seed: int, epoch: int, unit_len: int, seq_len: int, micro_batch: int) -> DataFrame:
    """(batch, row, shard_id, start): one epoch like ``windows_of_epochs``, but in the order of ``unit_permutation``.

    For replaying runs bit by bit: one task draws the permutation (8 bytes a unit), the rest is distributed.
    """
    if unit_len % seq_len:
        raise ValueError("unit_len must be a multiple of seq_len")
    per = unit_len // seq_len
    total = grid.agg(F.coalesce(F.sum("n_units"), F.lit(0)).alias("total"))

    def drawn(batches):
        for b in batches:
            for n in b.column(0).to_pylist():
                order = unit_permutation(n, seed, epoch, unit_len)
                for i in range(0, n, 100_000):
                    part = order[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), pa.array(part)], ["place", "unit"])

    w = total.mapInArrow(drawn, "place bigint, unit bigint").join(units(grid), "unit").join(F.broadcast(total))  # a single row
    w = w.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    number = F.col("place") * per + F.col("k")
    batch = F.floor(number / micro_batch)
    return w.filter(batch < F.floor(F.col("total") * per / micro_batch)).select(
        batch.alias("batch"), (number % micro_batch).alias("row"), "shard_id", ((F.col("unit") - F.col("first_unit")) * unit_len + F.col("k") * seq_len).alias("start")
    )


def after_state(windows: DataFrame, epoch: int, batch: int) -> DataFrame:
    """The windows that a reader has still to read that stopped before ``batch`` of ``epoch``."""
    return windows.filter((F.col("epoch") > epoch) | (F.col("epoch") == epoch) & (F.col("batch") >= batch))


def check_state(saved: dict, current: dict) -> None:
    """Refuse to resume a reader whose shards, units or seed are not those of the saved state."""
    for k in ("shards", "unit_len", "seed"):
        if saved.get(k) != current.get(k):
            raise ValueError(f"cannot resume: {k} was {saved.get(k)!r}, is {current.get(k)!r}")


def after_stage_switch(position: Column, old_per_unit: Column, new_per_unit: Column) -> Column:
    """Position after a change of shape: the first window of the next untouched unit."""
    return F.ceil(position / old_per_unit) * new_per_unit


def spread_selection(n: int, fraction: float) -> Column:
    """``k = round(fraction * n)`` indices spread evenly over ``n``, rounding half to even."""
    k = F.bround(F.lit(float(fraction) * n)).cast("bigint")
    return F.when(k > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(k - 1, F.lit(0))), lambda i: F.floor(i * n / k))).otherwise(F.array().cast("array<bigint>"))
