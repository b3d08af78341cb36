"""Mixing sources by weight, sampling and permuting.

``interleave`` paces each source by its weight and needs no draw; ``drawn_order`` replays the draws of a seeded generator
on the driver from the sources' sizes alone, for bit-exact runs of bounded size. Sources that run out drop out.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from garimpo.plans.prefix import running_offset, running_rank


def check_weights(sources: list[str], weights: dict[str, float] | None) -> dict[str, float]:
    """Positive weights of all sources; uniform if none are given."""
    if not sources:
        raise ValueError("no sources")
    weights = {s: 1 / len(sources) for s in sources} if weights is None else dict(weights)
    for s, w in weights.items():
        if w <= 0:
            raise ValueError(f"weight of {s} must be positive")
    if missing := [s for s in sources if s not in weights]:
        raise ValueError(f"no weight for {missing}")
    return weights


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows of all sources with their source as ``_source``; columns that a source lacks are null."""
    if not sources:
        raise ValueError("no sources")
    out = None
    for name, df in sources.items():
        df = df.withColumn("_source", F.coalesce(F.col("_source"), F.lit(name))) if "_source" in df.columns else df.withColumn("_source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def interleave(df: DataFrame, source: str, order: str, weights: dict[str, float]) -> DataFrame:
    """``df`` with ``pace``: sorted by it, each prefix holds the sources by weight as far as they last."""
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    ranked = running_rank(df.filter(F.col(source).isin(list(weights))), source, order, "_k")
    return ranked.withColumn("pace", F.col("_k") / F.element_at(w, F.col(source))).drop("_k")


def drawn_order(sizes: dict[str, int], weights: dict[str, float] | None = None, seed: int = 42, most: int = 10_000_000) -> list[tuple[int, str, int]]:
    """(draw, source, index in the source) until all sources are used up."""
    weights = check_weights(list(sizes), weights)
    if sum(sizes.values()) > most:
        raise ValueError(f"more than {most} documents; use interleave")
    rng, left, out = random.Random(seed), dict(sizes), []
    while left:
        names = list(left)
        s = rng.choices(names, weights=[weights[n] for n in names], k=1)[0]
        if left[s] == 0:
            del left[s]
            continue
        out.append((len(out), s, sizes[s] - left[s]))
        left[s] -= 1
    return out


def draw(df: DataFrame, source: str, order: str, weights: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """``df`` with ``draw``, the number of the draw that takes each row."""
    sizes = {r[0]: r[1] for r in df.groupBy(source).count().orderBy(source).collect()}
    plan = df.sparkSession.createDataFrame(drawn_order(sizes, weights, seed), f"draw bigint, {source} string, _k bigint")
    return running_rank(df, source, order, "_k").withColumn("_k", F.col("_k") - 1).join(plan, [source, "_k"]).drop("_k")


def hash_order(key: Column, seed: str) -> Column:
    """A pseudo-random key that every engine can compute."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample(df: DataFrame, key: str, k: int, seed: str = "0") -> DataFrame:
    """A uniform sample of ``k`` rows, the same on every run."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(k)


def permutation(df: DataFrame, key: str, seed: str) -> DataFrame:
    """``df`` with ``rank_key``, the sort key of a pseudo-random permutation."""
    return df.withColumn("rank_key", hash_order(F.col(key), seed))


def nucleus(counts: DataFrame, key: str, n: str, top_k: int, top_p: float) -> DataFrame:
    """(key, p): of the ``top_k`` most frequent keys, the fewest whose shares add up to ``top_p``; ties in order of the key."""
    top = counts.orderBy(F.desc(n), key).limit(top_k)  # at most top_k rows from here on
    order = W.orderBy(F.desc(n), key)
    whole = F.sum(n).over(W.partitionBy())
    before = F.coalesce(F.sum(n).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) / whole
    return top.select(key, (F.col(n) / whole).alias("p"), before.alias("_b")).filter(F.col("_b") < top_p).drop("_b")


def passes(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """``df`` once for each of ``n`` passes, with ``epoch`` and ``place``: a new order in every pass."""
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    keyed = each.withColumn("_k", F.md5(F.concat(F.lit(f"{seed}-"), "epoch", F.lit(":"), F.col(key).cast("string"))))
    return running_rank(keyed, "epoch", "_k", "place").drop("_k")


def _uniform(step: Column, seed) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), step.cast("string"))), 1, 8), 16, 10).cast("bigint")


def endless(df: DataFrame, source: str, order: str, weights: dict[str, float], draws: int, seed: int) -> DataFrame:
    """(step, source, row of ``order``): ``draws`` steps of a mixture that never ends; a used-up source starts again.

    Each step picks its source by a hash, and takes the next row of it by its running count.
    """
    whole, upto, pick = sum(weights.values()), 0.0, None
    u = _uniform(F.col("step"), seed) / F.lit(float(1 << 32))
    for name in sorted(weights):
        upto += weights[name]
        pick = F.when(F.lit(upto / whole) > u, name) if pick is None else pick.when(F.lit(upto / whole) > u, name)
    steps = df.sparkSession.range(draws).select(F.col("id").alias("step")).withColumn(source, pick)
    steps = running_rank(steps.filter(F.col(source).isNotNull()), source, "step", "_j")
    rows = running_rank(df.filter(F.col(source).isin(list(weights))), source, order, "_k")
    sizes = rows.groupBy(source).agg(F.count(F.lit(1)).alias("_n"))
    taken = steps.join(F.broadcast(sizes), source).withColumn("_k", F.pmod(F.col("_j") - 1, F.col("_n")) + 1)  # one row a source
    return taken.join(rows, [source, "_k"]).select("step", source, order)


def blend(real: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """(step, key, made): each step takes the next real row or a generated one, by halves; only generated ones when none is left."""
    steps = real.sparkSession.range(draws).select(F.col("id").alias("step"), (_uniform(F.col("id"), seed) % 2).alias("_real"))
    counted = running_offset(steps, "step", F.col("_real")).withColumn("_k", F.when(F.col("_real") == 1, F.col("off") + 1))
    rows = running_rank(real.withColumn("_g", F.lit(0)), "_g", key, "_k").select(key, "_k")
    return counted.join(rows, "_k", "left").select("step", key, F.col(key).isNull().alias("made"))


def draw_lengths(df: DataFrame, key: str, n: str, total: int, seed: str) -> DataFrame:
    """(i, n): lengths drawn from ``df`` with replacement until they add up to ``total`` exactly; the last one is cut."""
    rows = running_rank(df.filter(F.col(n) > 0).withColumn("_g", F.lit(0)), "_g", key, "_k").select((F.col("_k") - 1).alias("_k"), n)
    size = rows.count()
    if not size:
        raise ValueError("nothing to draw from")
    draws = df.sparkSession.range(total).select(F.col("id").alias("i"), (_uniform(F.col("id"), seed) % size).alias("_k"))  # each draw adds 1 at least
    placed = running_offset(draws.join(rows, "_k").drop("_k"), "i", F.col(n))
    return placed.filter(F.col("off") < total).select("i", F.least(F.col(n), F.lit(total) - F.col("off")).cast("bigint").alias("n"))


def synthetic_batch(spark: SparkSession, rows: int, seq_len: int, vocab: int, cuts: int) -> DataFrame:
    """(row, ids, cuts, labels): made-up tokens, document ends at random places within, labels masked at each end."""
    def number(sep, x):
        return F.conv(F.substring(F.md5(F.concat(F.col("row"), F.lit(sep), x)), 1, 8), 16, 10).cast("bigint")

    d = spark.range(rows).select(F.col("id").alias("row"))
    d = d.withColumn("ids", F.transform(F.sequence(F.lit(0), F.lit(seq_len - 1)), lambda i: number(":", i) % vocab))
    d = d.withColumn("cuts", F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(cuts - 1)), lambda j: number("-", j) % (seq_len - 1) + 1))))
    label = F.transform("ids", lambda x, i: F.when((i == seq_len - 1) | F.array_contains("cuts", (i + 1).cast("bigint")), F.lit(-100).cast("bigint")).otherwise(F.get("ids", i + 1)))
    return d.withColumn("labels", label)
