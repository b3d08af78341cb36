"""The whole preparation: fallbacks, cleaning and filters, deduplication, tokens, budget, shards, counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.functions.text import canonical_source, resolve_is_pt, source_fallback, text_fallback
from garimpo.operators import dedup, packing, quality
from garimpo.operators.mixing import check_weights, interleave
from garimpo.operators.tokenizer import encode
from garimpo.plans.materialize import materialize
from garimpo.plans.prefix import running_offset


@dataclass
class Prepared:
    documents: DataFrame  # seq, source, ids, off, written: what is written
    status: DataFrame  # seq, status, reason of every record
    parts: DataFrame  # the shards' parts
    eos: int
    cleaned: DataFrame  # seq, text, source of what the filters let pass

    def stats(self) -> DataFrame:
        """(status, reason, n): each record once; the reasons add up to the filtered ones."""
        return self.status.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))

    def tokens(self) -> DataFrame:
        return packing.shard_tokens(self.parts, "ids", self.eos, "source").withColumn("shard_id", F.col("shard_id").cast("int"))

    def sidecars(self, unit_len: int) -> DataFrame:
        return packing.sidecars(self.parts, "source", self.eos, unit_len)


def prepare(
    raw: DataFrame,
    max_tokens: int,
    shard_size: int = 1 << 28,
    eos: int = 1,
    tokenize=packing.hashed_ids,
    pt_sources: list[str] | None = None,
    tokenizer: tuple[DataFrame, DataFrame] | None = None,
    weights: dict[str, float] | None = None,
    capacity: int | None = None,
    **limits,
) -> Prepared:
    """Records (seq, text/content/raw_content, _source/source, is_pt) to shard parts; stages that are read twice are written tables.

    ``tokenizer`` (vocabulary, merges) encodes the texts; without one, ``tokenize`` gives the ids as a column. With
    ``weights``, the sources (in any spelling) are interleaved by them before anything else, records of other sources are
    left out, and the records' order is the mixture's. ``capacity`` bounds how many kept records a record is compared with.
    """
    have = set(raw.columns)
    text = text_fallback(*(F.col(c) for c in ("text", "content", "raw_content") if c in have))
    source = source_fallback(*(F.col(c) for c in ("_source", "source") if c in have))
    flag = F.col("is_pt") if "is_pt" in have else F.lit(None).cast("boolean")
    docs = raw.select("seq", text.alias("text"), source.alias("source"), resolve_is_pt(flag, source, pt_sources).alias("is_pt"))
    if weights is not None:
        docs = mixed(docs, weights)
    judged = materialize(quality.with_reason(docs, F.col("is_pt"), **limits).drop("is_pt"), "judged")
    passed = judged.filter("reason is null").select("seq", "text", "source")
    alone = passed.select("seq", "text")
    kept = (dedup.greedy_dedup(alone) if capacity is None else dedup.windowed_dedup(alone, capacity)).select("seq")
    new = passed.join(kept, "seq", "left_semi")
    tokens = encode(new, *tokenizer) if tokenizer else new.select("seq", "source", tokenize(F.col("text")).alias("ids"))
    tokens = materialize(tokens.select("seq", "source", "ids"), "tokens")
    written = materialize(packing.token_budget(tokens.filter(F.size("ids") > 0), "seq", F.size("ids"), max_tokens), "written")
    status = (
        judged.select("seq", "reason")
        .join(tokens.select("seq", (F.size("ids") > 0).alias("some")), "seq", "left")
        .join(written.select("seq", F.lit(True).alias("written")), "seq", "left")
        .select("seq", F.when(F.col("reason").isNotNull(), "filtered").when(F.col("some").isNull(), "duplicated").when(~F.col("some"), "empty_tokens").when(F.col("written"), "accepted").otherwise("over_budget").alias("status"), "reason")
    )
    return Prepared(written, status, packing.shard_parts(written, shard_size), eos, passed)


def mixed(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``docs`` of the sources of ``weights``, ``seq`` being the place in their mixture."""
    check_weights(list(weights), weights)
    named = docs.withColumn("source", canonical_source(F.col("source")))
    paced = interleave(named, "source", "seq", weights).withColumn("_at", F.struct("pace", "seq"))
    return running_offset(paced, "_at", F.lit(1)).withColumn("seq", F.col("off")).drop("off", "_at", "pace")
