"""Analytics of training logs and traces: final losses, gates, spikes, intervals, schedules.

Log lines carry ``run``, ``line`` and values; a line received twice counts once (``first_received``).
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Categories of kernels by name, in order of precedence.
KERNELS = (
    ("gdn", r"^(chunk_|recompute_w_u|prepare_wy_repr|l2norm_|fused_recurrent|fused_gdn|solve_tril|merge_16x16|causal_conv1d)|gated_delta"),
    ("attention", r"flex_attention|fmha_|flash_(fwd|bwd)|pytorch_flash|efficient_attention"),
    ("loss", r"nll_loss|log_softmax|LogSoftMax|SoftMax(Forward|Backward)|softmax_warp|cross_entropy"),
    ("matmul", r"gemm|gemv|cutlass|cublas|xmma|nvjet|^triton_tem_"),
    ("elementwise", r"^triton_(poi|red|per)_|elementwise_kernel|reduce_kernel|multi_tensor_apply|CatArrayBatchedCopy|index_elementwise|gather_kernel|indexSelect|lpnorm|embedding_backward"),
)


def first_received(log: DataFrame) -> DataFrame:
    """Each (run, line) once, as first received."""
    cols = [c for c in log.columns if c not in ("run", "line")]
    first = log.groupBy("run", "line").agg(F.min_by(F.struct(*cols), "received_at").alias("x"))
    return first.select("run", "line", *(F.col(f"x.{c}").alias(c) for c in cols))


def finite(c: Column) -> Column:
    """The value, null if it isn't finite."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def final_loss(log: DataFrame, key: str = "lm_loss", share: float = 0.1) -> DataFrame:
    """(run, n, final): mean of the last ``ceil(share * n)`` non-null values of each run, in order of lines."""
    d = log.filter(F.col(key).isNotNull())
    n = d.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    last = d.select("run", F.col(key).alias("v"), F.row_number().over(W.partitionBy("run").orderBy(F.desc("line"))).alias("k")).join(n, "run")
    return last.filter(F.col("k") <= F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n") - 1e-12))).groupBy("run").agg(F.max("n").alias("n"), F.avg("v").alias("final"))


def gate(reference: Column, candidate: Column, exact: bool, noise: Column | float = 0.0) -> Column:
    """(gap, passed): exact runs may differ by the noise (0.005 at least) either way, lossy ones be worse by 0.01."""
    gap = (candidate - reference) / reference
    noise = noise if isinstance(noise, Column) else F.lit(float(noise))
    return F.struct(gap.alias("gap"), (F.abs(gap) <= F.greatest(noise, F.lit(0.005)) if exact else gap <= 0.01).alias("passed"))


def spikes(log: DataFrame, key: str = "loss", threshold: float = 0.3, beta: float = 0.98) -> DataFrame:
    """(run, line, spike, ema): a finite value above ``ema * (1 + threshold)`` is a spike; all others move the average.

    The average depends on every decision before, so a run is one ordered fold: runs are spread over tasks and
    streamed in order, with one number of state.
    """

    def fold(batches):
        run, ema = None, None
        for b in batches:
            out, avg = [], []
            for r, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if r != run:
                    run, ema = r, None
                hit = False
                if v is not None and math.isfinite(v):
                    if ema is None:
                        ema = v
                    elif v > ema * (1 + threshold):
                        hit = True
                    else:
                        ema = beta * ema + (1 - beta) * v
                out.append(hit)
                avg.append(ema)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_()), pa.array(avg, pa.float64())], ["run", "line", "spike", "ema"])

    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return log.select("run", "line", F.col(key).cast("double").alias("v")).repartition(parts, "run").sortWithinPartitions("run", "line").mapInArrow(fold, "run string, line bigint, spike boolean, ema double")


def crossed(before: Column, after: Column, every: int) -> Column:
    """Whether a multiple of ``every`` lies in (before, after]."""
    return F.floor(after / every) > F.floor(before / every)


def interval_union(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, busy): length of the union of each key's intervals; overlaps count once."""
    w = W.partitionBy(key).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    covered = F.max(end).over(w)
    new = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(covered, F.col(start))))
    return intervals.filter(F.col(end) > F.col(start)).withColumn("_new", new).groupBy(key).agg(F.sum("_new").alias("busy"))


def categorize(name: Column) -> Column:
    """Category of a kernel: the first rule that matches, else ``other``."""
    out = None
    for cat, pattern in KERNELS:
        out = F.when(name.rlike(pattern), cat) if out is None else out.when(name.rlike(pattern), cat)
    return out.otherwise("other")


def breakdown(rows: DataFrame, category: str, value: Column, categories: list[str]) -> DataFrame:
    """(category, total) of every category, 0 included."""
    sums = rows.groupBy(category).agg(F.sum(value).alias("total"))
    every = rows.sparkSession.createDataFrame([(c,) for c in categories], f"{category} string")
    return every.join(sums, category, "left").select(category, F.coalesce("total", F.lit(0)).alias("total"))


def wsd(step: Column, warmup: int, total: int, decay: float) -> Column:
    """Multiplier of the learning rate: linear warm-up, plateau, ``1 - sqrt(progress)``, 0 at the end."""
    if warmup < 0 or total <= 0 or not 0 <= decay <= 1 or warmup > total - decay * total:
        raise ValueError("invalid schedule")
    begin = total - decay * total
    tail = 1 - F.sqrt(F.greatest(F.lit(0.0), (step - begin) / (total - begin))) if begin < total else F.lit(1.0)
    up = step / warmup if warmup else F.lit(1.0)
    return F.when(step >= total, 0.0).when(step < warmup, up).when(step < begin, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))


def linear_ramp(step: Column, total: int, start: float, end: float) -> Column:
    if total <= 0:
        raise ValueError("total must be positive")
    return start + (end - start) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), step / max(total - 1, 1)))


def cosine(step: Column, warmup: int, total: int, top: float, low: float) -> Column:
    """Linear warm-up to ``top``, then a half cosine down to ``low``."""
    progress = (step - warmup) / max(total - warmup, 1)
    return F.when(step < warmup, top * (step + 1) / max(warmup, 1)).when(step >= total, low).otherwise(low + 0.5 * (top - low) * (1 + F.cos(F.lit(math.pi) * progress)))


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(20.0)))


def active_stage(rows: DataFrame, tokens: str, stages: list[tuple[str, int]]) -> DataFrame:
    """``rows`` with ``stage``: the first whose bound lies above the tokens, else the last. Stages are a short list."""
    out = None
    for name, until in sorted(stages, key=lambda s: s[1]):
        cond = F.col(tokens) < until
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return rows.withColumn("stage", out.otherwise(max(stages, key=lambda s: s[1])[0]))
