"""Queries on training logs, with events as intervals."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from garimpo.operators import runlog as R
from garimpo.plans.prefix import running_offset
from garimpo.plans.registry import query, table

LOG = "WITH g AS (SELECT * FROM train_log QUALIFY row_number() OVER (PARTITION BY run, line ORDER BY received_at) = 1)"


def _log(spark, folder):
    return R.first_received(table(spark, folder, "train_log"))


FINAL = LOG + ", v AS (SELECT run, line, lm_loss, row_number() OVER (PARTITION BY run ORDER BY line DESC) AS k, count(*) OVER (PARTITION BY run) AS n FROM g WHERE lm_loss IS NOT NULL), f AS (SELECT run, max(n) AS n, avg(lm_loss) AS final FROM v WHERE k <= greatest(1, ceil(0.1 * n)) GROUP BY run)"


@query(FINAL + " SELECT run, n, round(final, 6) AS final FROM f")
def final_loss(spark, folder):
    return R.final_loss(_log(spark, folder)).select("run", "n", F.round("final", 6).alias("final"))


def _against(spark, folder):
    f = R.final_loss(_log(spark, folder))
    return f.crossJoin(F.broadcast(f.filter("run = 'b0_8_main'").select(F.col("final").alias("ref"))))  # a single row


@query(FINAL + " SELECT f.run, round((f.final - r.final) / r.final, 6) AS gap, abs((f.final - r.final) / r.final) <= 0.005 AS exact_passed, (f.final - r.final) / r.final <= 0.01 AS lossy_passed FROM f, f r WHERE r.run = 'b0_8_main'")
def quality_gate(spark, folder):
    x = _against(spark, folder).select("run", R.gate(F.col("ref"), F.col("final"), True).alias("e"), R.gate(F.col("ref"), F.col("final"), False).alias("l"))
    return x.select("run", F.round("e.gap", 6).alias("gap"), F.col("e.passed").alias("exact_passed"), F.col("l.passed").alias("lossy_passed"))


@query(FINAL + " SELECT count(*)::BIGINT AS n_runs, sum((abs((f.final - r.final) / r.final) > 0.005)::INT)::BIGINT AS n_failed FROM f, f r WHERE r.run = 'b0_8_main'")
def compare_runs(spark, folder):
    x = _against(spark, folder).select(R.gate(F.col("ref"), F.col("final"), True).alias("e"))
    return x.agg(F.count(F.lit(1)).alias("n_runs"), F.sum((~F.col("e.passed")).cast("bigint")).alias("n_failed"))


@query(LOG + " SELECT run, round(median(tok_s), 6) AS tok_s, round(median(mfu), 6) AS mfu FROM g WHERE step > 5 GROUP BY run")
def phase_medians(spark, folder):
    return _log(spark, folder).filter("step > 5").groupBy("run").agg(F.round(F.median("tok_s"), 6).alias("tok_s"), F.round(F.median("mfu"), 6).alias("mfu"))


@query(LOG + " SELECT run, round(sum(loss * seq_len) / sum(CASE WHEN loss IS NOT NULL THEN seq_len END), 6) AS mean_loss FROM g GROUP BY run")
def weighted_mean(spark, folder):
    return _log(spark, folder).groupBy("run").agg(F.round(F.sum(F.col("loss") * F.col("seq_len")) / F.sum(F.when(F.col("loss").isNotNull(), F.col("seq_len"))), 6).alias("mean_loss"))


@query(LOG + ", s AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY run, step ORDER BY line DESC) = 1), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) <= 50) SELECT run, count(*)::BIGINT AS n, round(avg(loss), 6) AS loss, round(avg(mtp_loss), 6) AS mtp_loss, max(tokens) AS tokens, sum(skipped::INT)::BIGINT AS n_skipped FROM t GROUP BY run")
def metrics_tail(spark, folder):
    s = _log(spark, folder).withColumn("k", F.row_number().over(W.partitionBy("run", "step").orderBy(F.desc("line")))).filter("k = 1")
    t = s.withColumn("k", F.row_number().over(W.partitionBy("run").orderBy(F.desc("step")))).filter("k <= 50")
    return t.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loss"), 6).alias("loss"), F.round(F.avg("mtp_loss"), 6).alias("mtp_loss"), F.max("tokens").alias("tokens"), F.sum(F.col("skipped").cast("bigint")).alias("n_skipped"))


@query(LOG + " SELECT run, coalesce(avg(loss), 0.0) AS mean FROM (SELECT * FROM g WHERE loss IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run ORDER BY line) <= 10) GROUP BY run")
def validation_mean(spark, folder):
    first = _log(spark, folder).filter("loss is not null").withColumn("k", F.row_number().over(W.partitionBy("run").orderBy("line"))).filter("k <= 10")
    return first.groupBy("run").agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("mean"))


SPIKES = (
    LOG.replace("WITH", "WITH RECURSIVE", 1)
    + ", n AS (SELECT run, line, loss AS v, row_number() OVER (PARTITION BY run ORDER BY line) AS k FROM g), s AS (SELECT run, line, k, false AS spike, v AS ema FROM n WHERE k = 1 UNION ALL "
    "SELECT n.run, n.line, n.k, coalesce(n.v > s.ema * 1.3, false), CASE WHEN n.v IS NULL THEN s.ema WHEN s.ema IS NULL THEN n.v WHEN n.v > s.ema * 1.3 THEN s.ema ELSE 0.98 * s.ema + (1 - 0.98) * n.v END FROM s JOIN n ON n.run = s.run AND n.k = s.k + 1)"
)


@query(SPIKES + " SELECT run, line, spike, round(ema, 6) AS ema FROM s")
def loss_spikes(spark, folder):
    return R.spikes(_log(spark, folder)).select("run", "line", "spike", F.round("ema", 6).alias("ema"))


@query(LOG + " SELECT run, line FROM (SELECT run, line, tokens, lag(tokens) OVER (PARTITION BY run ORDER BY line) AS before FROM g) WHERE tokens // 100000 > before // 100000")
def checkpoint_crossings(spark, folder):
    d = _log(spark, folder).withColumn("before", F.lag("tokens").over(W.partitionBy("run").orderBy("line")))
    return d.filter(R.crossed(F.col("before"), F.col("tokens"), 100_000)).select("run", "line")


@query(LOG + " SELECT run, line FROM (SELECT run, line, loss, coalesce(min(loss) OVER (PARTITION BY run ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e9) AS best FROM g) WHERE loss < best")
def running_best(spark, folder):
    w = W.partitionBy("run").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return _log(spark, folder).withColumn("best", F.coalesce(F.min("loss").over(w), F.lit(1e9))).filter("loss < best").select("run", "line")


@query(LOG + " SELECT run, line, CASE WHEN loss IS NULL OR isnan(loss) OR isinf(loss) THEN NULL ELSE loss END AS loss FROM g")
def metrics_rows(spark, folder):
    return _log(spark, folder).select("run", "line", R.finite(F.col("loss")).alias("loss"))


@query(LOG + " SELECT run, line FROM g WHERE isfinite(loss) AND isfinite(grad_norm)")
def finite_only(spark, folder):
    return _log(spark, folder).filter(R.finite(F.col("loss")).isNotNull() & R.finite(F.col("grad_norm")).isNotNull()).select("run", "line")


@query(LOG + " SELECT run, max_by(step, line) AS last_step, max_by(step, line) >= 60 AS finished FROM g GROUP BY run")
def run_finished(spark, folder):
    return _log(spark, folder).groupBy("run").agg(F.max_by("step", "line").alias("last_step")).select("run", "last_step", (F.col("last_step") >= 60).alias("finished"))


@query(LOG + " SELECT run, line, CASE WHEN tokens < 100000 THEN 'short' WHEN tokens < 400000 THEN 'middle' ELSE 'long' END AS stage FROM g")
def active_stage(spark, folder):
    return R.active_stage(_log(spark, folder), "tokens", [("short", 100_000), ("middle", 400_000), ("long", 1_000_000)]).select("run", "line", "stage")


@query(LOG + " SELECT run, line, round(CASE WHEN step >= 300 THEN 0.0 WHEN step < 20 THEN step / 20 WHEN step < 240 THEN 1.0 ELSE 1 - sqrt((step - 240) / 60) END, 6) AS multiplier FROM g")
def wsd_schedule(spark, folder):
    return _log(spark, folder).select("run", "line", F.round(R.wsd(F.col("step"), 20, 300, 0.2), 6).alias("multiplier"))


@query(LOG + " SELECT run, line, round(0.3 + (0.1 - 0.3) * least(1.0, greatest(0.0, step / 299)), 6) AS weight FROM g")
def linear_ramp(spark, folder):
    return _log(spark, folder).select("run", "line", F.round(R.linear_ramp(F.col("step"), 300, 0.3, 0.1), 6).alias("weight"))


@query(LOG + " SELECT run, line, round(CASE WHEN step < 20 THEN 0.001 * (step + 1) / 20 WHEN step >= 300 THEN 0.0001 ELSE 0.0001 + 0.5 * 0.0009 * (1 + cos(pi() * (step - 20) / 280)) END, 9) AS rate FROM g")
def cosine_schedule(spark, folder):
    return _log(spark, folder).select("run", "line", F.round(R.cosine(F.col("step"), 20, 300, 0.001, 0.0001), 9).alias("rate"))


@query(LOG + " SELECT run, line, round(exp(least(loss, 20)), 3) AS perplexity FROM g WHERE loss IS NOT NULL")
def perplexity(spark, folder):
    return _log(spark, folder).filter("loss is not null").select("run", "line", F.round(R.perplexity(F.col("loss")), 3).alias("perplexity"))


@query(LOG + " SELECT run, line, rank() OVER (ORDER BY skipped, tok_s DESC NULLS LAST) AS place FROM g")
def bench_rank(spark, folder):
    """Fastest lines first, skipped ones last; places are running counts over ranges of speeds, not a window in one task."""
    d = _log(spark, folder).select("run", "line", F.struct("skipped", F.col("tok_s").isNull().alias("none"), (-F.col("tok_s")).alias("slow")).alias("speed"))
    speeds = running_offset(d.groupBy("speed").agg(F.count(F.lit(1)).alias("n")), "speed", F.col("n"))
    return d.join(speeds, d["speed"].eqNullSafe(speeds["speed"])).select("run", "line", (F.col("off") + 1).alias("place"))


@query(LOG + " SELECT seq_len, max(tok_s) AS tok_s FROM g WHERE NOT skipped AND NOT spike GROUP BY seq_len")
def best_exact(spark, folder):
    return _log(spark, folder).filter("not skipped and not spike").groupBy("seq_len").agg(F.max("tok_s").alias("tok_s"))


@query(LOG + " SELECT run, line FROM g WHERE NOT coalesce(skipped, false) AND coalesce(isfinite(grad_norm), false) AND seq_len = 4096")
def bench_eligible(spark, folder):
    ok = ~F.coalesce("skipped", F.lit(False)) & R.finite(F.col("grad_norm")).isNotNull() & (F.col("seq_len") == 4096)
    return _log(spark, folder).filter(ok).select("run", "line")


@query(LOG + " SELECT run, line FROM g QUALIFY row_number() OVER (PARTITION BY run ORDER BY line DESC) <= 3")
def keep_newest(spark, folder):
    return _log(spark, folder).withColumn("k", F.row_number().over(W.partitionBy("run").orderBy(F.desc("line")))).filter("k <= 3").select("run", "line")


@query(LOG + " SELECT run, '| ' || run || ' | ' || count(*) || ' | ' || max(tokens) || ' |' AS row FROM g GROUP BY run")
def markdown_rows(spark, folder):
    return _log(spark, folder).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max("tokens").alias("t")).select("run", F.concat(F.lit("| "), "run", F.lit(" | "), F.col("n"), F.lit(" | "), F.col("t"), F.lit(" |")).alias("row"))


@query("SELECT event_id, CASE WHEN regexp_matches(event_type, 'gemm|view') THEN 'matmul' WHEN regexp_matches(event_type, 'click') THEN 'loss' ELSE 'other' END AS category FROM events")
def categorize(spark, folder):
    name = F.when(F.col("event_type") == "view", "sm80_gemm_view").when(F.col("event_type") == "click", "nll_loss_click").otherwise(F.col("event_type"))
    return table(spark, folder, "events").select("event_id", R.categorize(name).alias("category"))


@query("SELECT c.event_type, coalesce(round(sum(e.value), 4), 0) AS total FROM (SELECT unnest(['click', 'view', 'purchase', 'error', 'never']) AS event_type) c LEFT JOIN events e USING (event_type) GROUP BY 1")
def kernel_breakdown(spark, folder):
    b = R.breakdown(table(spark, folder, "events"), "event_type", F.col("value"), ["click", "view", "purchase", "error", "never"])
    return b.select("event_type", F.round("total", 4).alias("total"))


UNION = "WITH i AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + (value * 60000000)::BIGINT AS e FROM events WHERE value > 0), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM i WHERE e > s)"


@query(UNION + " SELECT user_id, sum(greatest(0, e - greatest(s, coalesce(covered, s))))::BIGINT AS busy FROM m GROUP BY user_id")
def interval_union(spark, folder):
    d = table(spark, folder, "events").filter("value > 0").select("user_id", F.expr("unix_micros(cast(ts as timestamp))").alias("s"), F.round(F.col("value") * 60_000_000).cast("bigint").alias("d"))
    return R.interval_union(d.select("user_id", "s", (F.col("s") + F.col("d")).alias("e")), "user_id", "s", "e")


@query("SELECT coalesce(suite, 'all') AS suite, count(*)::BIGINT AS n, round(avg((length(text) > 300)::INT), 6) AS accuracy FROM benchmark GROUP BY ROLLUP (suite)")
def category_accuracy(spark, folder):
    b = table(spark, folder, "benchmark").select("suite", (F.length("text") > 300).cast("int").alias("ok"))
    return b.rollup("suite").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ok"), 6).alias("accuracy")).select(F.coalesce("suite", F.lit("all")).alias("suite"), "n", "accuracy")


@query("SELECT suite, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS n_chars FROM benchmark GROUP BY suite")
def category_report(spark, folder):
    return table(spark, folder, "benchmark").groupBy("suite").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("bigint")).alias("n_chars"))


@query("SELECT s.seq_len, p.policy, f.fraction FROM (SELECT unnest([2048, 4096]) AS seq_len) s, (SELECT unnest(['full', 'ffn', 'selective']) AS policy) p, (SELECT unnest([0.5, 1.0])::DOUBLE AS fraction) f WHERE NOT (p.policy = 'full' AND f.fraction = 1.0)")
def bench_grid(spark, folder):
    """Twelve combinations of three short lists, less those that have run."""
    g = spark.range(1).select(F.explode(F.array(F.lit(2048), F.lit(4096))).alias("seq_len")).withColumn("policy", F.explode(F.array(F.lit("full"), F.lit("ffn"), F.lit("selective")))).withColumn("fraction", F.explode(F.array(F.lit(0.5), F.lit(1.0))))
    return g.filter("not (policy = 'full' and fraction = 1.0)")


@query("SELECT shard_id, concat_ws(', ', 'dtype=' || coalesce(dtype, 'none'), 'unit=' || coalesce(unit_len::VARCHAR, 'none')) AS description FROM shard_index")
def config_description(spark, folder):
    return table(spark, folder, "shard_index").select("shard_id", F.concat_ws(", ", F.concat(F.lit("dtype="), F.coalesce("dtype", F.lit("none"))), F.concat(F.lit("unit="), F.coalesce(F.col("unit_len").cast("string"), F.lit("none")))).alias("description"))


@query("SELECT run, max(seq_len) AS seq_len, max(seq_len)::BIGINT * 4 * coalesce(NULL, 8) AS tokens_per_step, 1000000000 // (max(seq_len)::BIGINT * 32) AS total_steps FROM train_log GROUP BY run")
def stage_plan(spark, folder):
    t = table(spark, folder, "train_log").groupBy("run").agg(F.max("seq_len").alias("seq_len"))
    per = F.col("seq_len").cast("bigint") * 4 * F.coalesce(F.lit(None).cast("int"), F.lit(8))
    return t.select("run", "seq_len", per.alias("tokens_per_step"), F.floor(F.lit(1_000_000_000) / per).alias("total_steps"))
