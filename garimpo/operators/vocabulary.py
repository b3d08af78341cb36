"""Pair-merge vocabularies as graphs: dependencies, closure, pruning to a size, new ids, remaps, fertility."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from garimpo.plans.materialize import materialize


def edges(merges: DataFrame) -> DataFrame:
    """(token, parent) of each merge result; of several merges with one result the last counts."""
    last = merges.withColumn("token", F.concat("left_token", "right_token")).groupBy("token").agg(F.max_by(F.array("left_token", "right_token"), "merge_rank").alias("parents"))
    return last.select("token", F.explode(F.array_distinct("parents")).alias("parent"))


def ancestors(edge: DataFrame, rounds: int = 64) -> DataFrame:
    """(token, ancestor): all tokens that a token is made of. Paths double in length each round."""
    closure = materialize(edge.select("token", F.col("parent").alias("ancestor")).distinct(), "closure")
    n = closure.count()
    for _ in range(rounds):
        step = closure.select("token", F.col("ancestor").alias("mid")).join(closure.select(F.col("token").alias("mid"), "ancestor"), "mid").select("token", "ancestor")
        closure = materialize(closure.unionByName(step).distinct(), "closure")
        m = closure.count()
        if m == n:
            return closure
        n = m
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def unclosed(vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """Merges whose result is in the vocabulary but a part is not; none in a closed vocabulary."""
    known = vocab.select("token").distinct()
    m = merges.withColumn("token", F.concat("left_token", "right_token")).join(known, "token", "left_semi")
    part = lambda c: m.join(known.withColumnRenamed("token", c), c, "left_anti").select("merge_rank")
    return part("left_token").unionByName(part("right_token")).distinct()


def pruned_merges(merges: DataFrame, selected: DataFrame) -> DataFrame:
    """The merges whose result and parts are all selected; ranks are kept."""
    known = selected.select("token").distinct()
    m = merges.withColumn("token", F.concat("left_token", "right_token")).join(known, "token", "left_semi")
    for c in ("left_token", "right_token"):
        m = m.join(known.withColumnRenamed("token", c), c, "left_semi")
    return m.select("merge_rank", "left_token", "right_token")


def select(vocab: DataFrame, merges: DataFrame, frequencies: DataFrame, protected: DataFrame, size: int) -> DataFrame:
    """(token): exactly ``size`` tokens, closed under the merges.

    Protected tokens and their ancestors come first, then tokens by falling frequency (ties in order of id) with what
    they miss, if it still fits, then what is cheapest to complete. Each choice depends on those before, so the choice itself
    is one ordered fold over the vocabulary (its size is fixed); closures are computed distributed.
    """
    above = ancestors(edges(merges)).groupBy("token").agg(F.collect_list("ancestor").alias("above"))
    rows = vocab.join(above, "token", "left").join(frequencies, "token", "left").join(protected.select("token", F.lit(True).alias("must")).distinct(), "token", "left")
    rows = rows.select("id", "token", F.coalesce("above", F.array().cast("array<string>")).alias("above"), F.coalesce("freq", F.lit(0)).alias("freq"), F.coalesce("must", F.lit(False)).alias("must"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        if size > len(pdf):
            raise ValueError(f"size {size} is more than the vocabulary's {len(pdf)}")
        need = {t: {t, *a} for t, a in zip(pdf["token"], pdf["above"])}
        chosen: set[str] = set()
        for t in pdf["token"][pdf["must"]]:
            chosen |= need[t]
        if len(chosen) > size:
            raise ValueError(f"size {size} is less than the {len(chosen)} protected tokens and their parts")
        often = pdf[pdf["freq"] > 0].sort_values("freq", ascending=False, kind="stable")
        for t in often["token"]:
            missing = need[t] - chosen
            if len(chosen) + len(missing) <= size:
                chosen |= missing
        rest = [t for t in pdf["token"] if t not in chosen]
        while len(chosen) < size:
            fit = [(len(need[t] - chosen), i) for i, t in enumerate(rest)]
            fit = [x for x in fit if 0 < x[0] <= size - len(chosen)]
            if not fit:
                raise RuntimeError(f"{len(chosen)} of {size} tokens can be selected")
            chosen |= need[rest[min(fit)[1]]]
            rest = [t for t in rest if t not in chosen]
        return pd.DataFrame({"token": sorted(chosen)})

    return rows.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(fold, "token string")


def contiguous_ids(selected: DataFrame, eos: str | None = None) -> DataFrame:
    """(token, old_id, new_id): new ids in order of the old ones, without gaps; the end mark is last."""
    w = W.orderBy(F.col("token") == (eos or ""), "old_id")
    return selected.select("token", F.col("id").alias("old_id")).withColumn("new_id", (F.row_number().over(w) - 1).cast("bigint"))


def remap(vocab: DataFrame, new_ids: DataFrame) -> DataFrame:
    """(old_id, new_id) of every token; -1 for those dropped."""
    return vocab.select("token", F.col("id").alias("old_id")).join(new_ids.select("token", "new_id"), "token", "left").select("old_id", F.coalesce("new_id", F.lit(-1)).cast("bigint").alias("new_id"))


def frequency_remap(counts: DataFrame, eos: int, size: int) -> DataFrame:
    """(old_id, new_id) from ``counts(old_id, n)``: 0 for the end mark, 2 and up by falling count (ties: lower id), 1 for the rest."""
    ranked = counts.filter((F.col("old_id") != eos) & (F.col("n") > 0)).orderBy(F.desc("n"), "old_id").limit(max(size - 2, 0))
    top = ranked.withColumn("new_id", (F.row_number().over(W.orderBy(F.desc("n"), "old_id")) + 1).cast("bigint")).select("old_id", "new_id")
    return counts.select("old_id").join(top, "old_id", "left").select("old_id", F.when(F.col("old_id") == eos, 0).otherwise(F.coalesce("new_id", F.lit(1))).cast("bigint").alias("new_id"))


def fertility(tokens: Column, words: Column) -> Column:
    """Tokens for each word: ratio of the sums."""
    return F.sum(tokens) / F.nullif(F.sum(words), F.lit(0))


def fertility_gate(base: Column, pruned: Column, most: float = 0.03) -> Column:
    """(ratio, degradation in percent, passed)."""
    ratio = pruned / base
    return F.struct(ratio.alias("ratio"), ((ratio - 1) * 100).alias("degradation"), (ratio <= 1 + most + 1e-9).alias("passed"))
