"""Problem 6: mixing sources to target weights by entropy balancing.

Every document starts with the rate 1 and the rates move as little as possible (in relative entropy) so that each
source's expected tokens reach its target. That makes them exponentially tilted, ``r = min(cap, exp(lambda_s * t))`` for
a document of ``t`` tokens of source ``s``. The dual in the ``lambda_s`` is convex; each Newton iteration is one
aggregation over the table of (source, size) counts and ends up with one row a source. The total is the largest one at
which all targets can be met within the caps, or a given smaller one; a given larger one is an error. Rates are rounded to copies by a hash of the document
id; a threshold on the hash, found in two aggregations, makes a source's rounded total meet its target as closely as
single documents allow.

Cases: documents whose source no target names, and documents without tokens, are left out (0 copies, no row). Null or
non-positive weights or caps leave their source out; weights are taken relative to the sum of those of the sources that
have documents. Of repeated targets of a source the greatest weight and cap count; a repeated ``doc_id`` counts once, with its
longest text. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.words import canonical
from garimpo.plans.materialize import materialize, spread

VOCABULARY = os.environ.get("GARIMPO_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: how byte-level pair encodings of this family cut a text.
CUT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BINS = 1 << 12


def public_tokens(df: DataFrame, path: str = VOCABULARY, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` with the text column replaced by its number of tokens under the public vocabulary at ``path``."""
    others = [c for c in df.columns if c != text]
    with open(path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def count(batches):
        import tiktoken

        encoding = tiktoken.Encoding("public", pat_str=CUT, mergeable_ranks=ranks.value, special_tokens={})
        for b in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(others))), pa.array(n, pa.int64())], [*others, out])

    return df.select(*others, text).mapInArrow(count, df.select(*others).withColumn(out, F.lit(0).cast("bigint")).schema)


def targets_of(targets: DataFrame) -> DataFrame:
    """(source, weight, cap): one valid target a source."""
    t = targets.select(canonical(F.col("source")).alias("source"), F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("bigint").alias("cap"))
    return t.groupBy("source").agg(F.max("weight").alias("weight"), F.max("cap").alias("cap")).filter("source is not null and weight > 0 and not isnan(weight) and cap > 0")


def solve(counts: DataFrame, plan: dict[str, tuple[float, float]], rounds: int = 60, tolerance: float = 1e-9) -> dict[str, float]:
    """``lambda`` of each source of ``plan`` (target tokens, cap): Newton steps on the dual, kept within a bracket.

    ``counts(source, n_tokens, n)`` stays distributed; each step collects one row a source.
    """
    scale = {s: 1.0 for s in plan}
    for r in counts.groupBy("source").agg((F.sum(F.col("n") * F.col("n_tokens")) / F.sum("n")).alias("m")).collect():
        scale[r["source"]] = float(r["m"])
    lam = {s: 0.0 for s in plan}
    low, high = {s: -math.inf for s in plan}, {s: math.inf for s in plan}
    open_ = set(plan)
    for _ in range(rounds):
        if not open_:
            break
        now = counts.sparkSession.createDataFrame([(s, lam[s] / scale[s], float(plan[s][1])) for s in open_], "source string, lam double, c double")
        tilt = F.exp(F.least(F.col("lam") * F.col("n_tokens"), F.log(F.col("c"))))
        got = (
            counts.join(F.broadcast(now), "source")  # one row a source
            .groupBy("source")
            .agg(F.sum(F.col("n") * F.col("n_tokens") * tilt).alias("g"), F.sum(F.when(tilt < F.col("c"), F.col("n") * F.col("n_tokens") * F.col("n_tokens") * tilt)).alias("h"))
            .collect()
        )
        for r in got:
            s, (want, _) = r["source"], plan[r["source"]]
            gap, slope = r["g"] - want, (r["h"] or 0.0) / scale[s]
            if abs(gap) <= tolerance * want:
                open_.discard(s)
                continue
            (high if gap > 0 else low)[s] = lam[s]
            step = lam[s] - gap / slope if slope > 0 else math.inf * -gap
            if not low[s] < step < high[s]:
                lo, hi = low[s], high[s]
                step = (lo + hi) / 2 if math.isfinite(lo) and math.isfinite(hi) else (hi * 2 - 1 if math.isfinite(hi) else lo * 2 + 1)
            if step == lam[s]:
                open_.discard(s)
            lam[s] = step
    return {s: lam[s] / scale[s] for s in plan}


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies) of every chosen document, and of no other."""
    sized = public_tokens(spread(docs.select("doc_id", canonical(F.col("source")).alias("source"), "text").filter("source is not null")), path)
    sized = materialize(sized.filter("n_tokens > 0").groupBy("doc_id").agg(F.max_by("source", F.struct("n_tokens", "source")).alias("source"), F.max("n_tokens").alias("n_tokens")), "sized")
    wanted = targets_of(targets)
    counts = materialize(sized.join(wanted.select("source"), "source").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")), "sizes")
    held = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens")).join(wanted, "source").collect()
    if not held:
        return sized.select("doc_id", "source", "n_tokens", F.lit(0.0).alias("rate"), F.lit(0).cast("bigint").alias("copies")).limit(0)
    weights = sum(r["weight"] for r in held)
    most = min(r["tokens"] * r["cap"] * weights / r["weight"] for r in held)
    if total is not None and total > most * (1 + 1e-9):
        raise ValueError(f"the targets can be met within the caps for at most {most:.0f} tokens, not {total:.0f}")
    total = most if total is None else min(total, most)
    plan = {r["source"]: (total * r["weight"] / weights, float(r["cap"])) for r in held}
    # a source that needs all its documents at its cap has no finite multiplier
    full = {r["source"] for r in held if plan[r["source"]][0] >= r["tokens"] * r["cap"] * (1 - 1e-9)}
    lam = solve(counts, {s: p for s, p in plan.items() if s not in full})
    rules = sized.sparkSession.createDataFrame([(s, lam.get(s, 0.0), plan[s][1], s in full) for s in plan], "source string, lam double, c double, is_full boolean")
    rate = F.when(F.col("is_full"), F.col("c")).otherwise(F.exp(F.least(F.col("lam") * F.col("n_tokens"), F.log("c"))))
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rated = sized.join(F.broadcast(rules), "source").select(  # one row a source
        "doc_id", "source", "n_tokens", rate.alias("rate"), "c", uniform.alias("u")
    )
    rated = rated.withColumn("base", F.least(F.floor(F.col("rate") + 1e-9), F.col("c")).cast("bigint")).withColumn("d", F.when(F.col("base") < F.col("c"), F.col("u") - (F.col("rate") - F.col("base"))))
    cut = _cuts(rated, {s: p[0] for s, p in plan.items()})
    cuts = sized.sparkSession.createDataFrame(list(cut.items()), "source string, cut double")
    chosen = rated.join(F.broadcast(cuts), "source")  # one row a source
    return chosen.select("doc_id", "source", "n_tokens", "rate", (F.col("base") + F.when(F.col("d") < F.col("cut"), 1).otherwise(0)).cast("bigint").alias("copies")).filter("copies > 0")


def _cuts(rated: DataFrame, wanted: dict[str, float]) -> dict[str, float]:
    """Threshold of each source: documents whose draw ``d`` is below it get one copy more.

    Two histograms of fixed size, the second over one bin of the first, settle it.
    """
    need = {r["source"]: wanted[r["source"]] - r["t"] for r in rated.groupBy("source").agg(F.sum(F.col("base") * F.col("n_tokens")).alias("t")).collect()}
    low, width = {s: -1.0 for s in need}, 2.0 / BINS
    for _ in range(2):
        edges = rated.sparkSession.createDataFrame(list(low.items()), "source string, low double")
        bins = (
            rated.filter("d is not null")
            .join(F.broadcast(edges), "source")  # one row a source
            .withColumn("b", F.floor((F.col("d") - F.col("low")) / F.lit(width)))
            .filter((F.col("b") >= 0) & (F.col("b") < BINS))
            .groupBy("source", "b")
            .agg(F.sum("n_tokens").alias("t"))
            .toPandas()
        )
        for s in need:
            own = bins[bins["source"] == s].sort_values("b")
            run = np.cumsum(own["t"].to_numpy(float))
            k = int(np.searchsorted(run, need[s], side="right"))
            need[s] -= run[k - 1] if k else 0.0
            low[s] += width * (float(own["b"].iloc[k]) if k < len(own) else float(BINS))
        width /= BINS
    return low


def shares(docs: DataFrame, targets: DataFrame, total: float | None = None, path: str = VOCABULARY) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_documents, most_copies) of each target source with documents."""
    got = mix(docs, targets, total, path).groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.count(F.lit(1)).alias("n_documents"), F.max("copies").alias("most_copies")
    )
    got = materialize(got.join(targets_of(targets), "source"), "shares")
    all_weight, all_tokens = got.agg(F.sum("weight"), F.sum("n_tokens")).first()
    return got.select(
        "source", (F.col("weight") / F.lit(all_weight)).alias("target_share"), (F.col("n_tokens") / F.lit(all_tokens)).alias("actual_share"), "n_tokens", "n_documents", "most_copies"
    )
