"""Queries on token sequences, made of the documents' words with hashed ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from garimpo.functions.text import text_fallback
from garimpo.operators import packing as P
from garimpo.plans.prefix import running_offset, running_rank
from garimpo.plans.registry import query, table, texts
from garimpo.plans.text_queries import WORDS

EOS = 1
IDS = f"list_transform({WORDS('text')}, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % 50000 + 2)"
DOC = f"WITH d AS (SELECT doc_id, coalesce(source, 'unknown') AS source, {IDS} AS ids FROM documents), t AS (SELECT *, len(ids)::BIGINT AS n, ids || [1::BIGINT] AS tokens FROM d)"
OFF = DOC + ", o AS (SELECT *, coalesce(sum(n + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM t)"


def docs(spark, folder):
    d = texts(spark, folder, "documents")
    return d.select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), P.hashed_ids(F.col("text")).alias("ids"))


def ended(spark, folder):
    """Documents with the end mark appended, as ``tokens``."""
    return docs(spark, folder).withColumn("tokens", F.concat("ids", F.array(F.lit(EOS).cast("bigint"))))


@query(DOC + " SELECT doc_id, n AS n_tokens, list_sum(ids)::BIGINT AS id_sum FROM t")
def tokenize(spark, folder):
    s = F.when(F.size("ids") > 0, F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x))
    return docs(spark, folder).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), s.alias("id_sum"))


@query(DOC + " SELECT doc_id FROM t WHERE n > 0")
def drop_empty_tokens(spark, folder):
    return docs(spark, folder).filter(F.size("ids") > 0).select("doc_id")


@query(DOC + " SELECT doc_id, len(list_filter(ids, lambda x: x < 0 OR x > 4294967295)) = 0 AS valid FROM t")
def token_domain(spark, folder):
    return docs(spark, folder).select("doc_id", P.valid_ids(F.col("ids")).alias("valid"))


@query(OFF + " SELECT doc_id, off, n + 1 AS n FROM o")
def token_offsets(spark, folder):
    return running_offset(docs(spark, folder), "doc_id", F.size("ids") + 1).select("doc_id", "off", (F.size("ids") + 1).cast("bigint").alias("n"))


BUDGET = OFF + ", b AS (SELECT *, least(n + 1, 50000 - off)::BIGINT AS written FROM o WHERE off < 50000)"


def _budget(spark, folder, most=50_000):
    return P.token_budget(docs(spark, folder), "doc_id", F.size("ids"), most)


@query(BUDGET + " SELECT doc_id, off, written FROM b")
def token_budget(spark, folder):
    return _budget(spark, folder).select("doc_id", "off", F.col("written").cast("bigint").alias("written"))


@query(BUDGET + " SELECT count(*)::BIGINT AS n_documents, sum(written)::BIGINT AS n_tokens FROM b")
def budget_limit(spark, folder):
    return _budget(spark, folder).agg(F.count(F.lit(1)).alias("n_documents"), F.sum("written").cast("bigint").alias("n_tokens"))


@query(BUDGET + " SELECT doc_id, md5(array_to_string(CASE WHEN written = 1 THEN [1::BIGINT] ELSE ids[1:written - 1] || [1::BIGINT] END, ',')) AS tokens_md5 FROM b")
def exact_sample(spark, folder):
    body = F.concat(F.slice("ids", F.lit(1), (F.col("written") - 1).cast("int")), F.array(F.lit(EOS).cast("bigint")))
    return _budget(spark, folder).select("doc_id", F.md5(F.array_join(body, ",")).alias("tokens_md5"))


SPILL = OFF + (
    ", b AS (SELECT *, (n + 1)::BIGINT AS written FROM o), s AS (SELECT *, unnest(generate_series(off // 4096, (off + written - 1) // 4096)) AS k FROM b), p AS (SELECT doc_id, source, ids, off, written, k AS shard_id, "
    "greatest(off, k * 4096) - k * 4096 AS shard_pos, greatest(off, k * 4096) - off AS frm, least(off + written, (k + 1) * 4096) - greatest(off, k * 4096) AS n_part FROM s)"
)


def placed(spark, folder):
    """All documents one behind the other, ``written`` whole; the budget is no matter of the shards."""
    n = F.size("ids") + 1
    return running_offset(docs(spark, folder), "doc_id", n).withColumn("written", n.cast("bigint"))


def _parts(spark, folder):
    return P.shard_parts(placed(spark, folder), 4096)


@query(SPILL + " SELECT doc_id, shard_id::BIGINT AS shard_id, shard_pos::BIGINT AS shard_pos, n_part::BIGINT AS n_part FROM p")
def shard_spill(spark, folder):
    return _parts(spark, folder).select("doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("shard_id", "shard_pos", "n_part")))


@query(SPILL + ", f AS (SELECT shard_id, shard_pos, (CASE WHEN written = 1 THEN [1::BIGINT] ELSE ids[1:written - 1] || [1::BIGINT] END)[frm + 1:frm + n_part] AS t FROM p) SELECT shard_id::BIGINT AS shard_id, md5(string_agg(array_to_string(t, ','), ',' ORDER BY shard_pos)) AS tokens_md5 FROM f GROUP BY shard_id")
def shard_tokens(spark, folder):
    t = P.shard_tokens(_parts(spark, folder), "ids", EOS)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("shard_pos", F.array_join("tokens", ",").alias("t")))), lambda x: x["t"])  # a shard has a fixed size
    return t.groupBy(F.col("shard_id").cast("bigint").alias("shard_id")).agg(F.md5(F.array_join(ordered, ",")).alias("tokens_md5"))


@query(SPILL + ", g AS (SELECT shard_id, source, sum(n_part)::BIGINT AS n FROM p GROUP BY ALL) SELECT shard_id::BIGINT AS shard_id, sum(n)::BIGINT AS n_tokens, string_agg(source || '=' || n, ';' ORDER BY source) AS sources FROM g GROUP BY shard_id")
def shard_sidecar(spark, folder):
    s = P.sidecars(_parts(spark, folder), "source", EOS, 1024)
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("sources")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return s.select(F.col("shard_id").cast("bigint").alias("shard_id"), F.col("n_tokens").cast("bigint").alias("n_tokens"), listed.alias("sources"))


@query(SPILL + " SELECT shard_id::BIGINT AS shard_id, source, sum(n_part)::BIGINT AS n_tokens FROM p GROUP BY ALL")
def tokens_by_shard_source(spark, folder):
    return _parts(spark, folder).groupBy(F.col("shard_id").cast("bigint").alias("shard_id"), "source").agg(F.sum("n_part").cast("bigint").alias("n_tokens"))


@query(DOC + " SELECT source, sum(n + 1)::BIGINT AS n_tokens, round(sum(n + 1) / sum(sum(n + 1)) OVER (), 6) AS share FROM t GROUP BY source")
def domain_mix(spark, folder):
    by = docs(spark, folder).groupBy("source").agg(F.sum(F.size("ids") + 1).alias("n_tokens"))
    whole = by.agg(F.sum("n_tokens")).first()[0] or 0
    return by.select("source", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.round(F.col("n_tokens") / F.lit(whole), 6).alias("share"))


@query(DOC + " SELECT doc_id, md5(array_to_string(list_transform(generate_series(1, n), lambda i: CASE WHEN tokens[i] = 1 THEN -100 ELSE tokens[i + 1] END), ',')) AS labels_md5 FROM t")
def next_token_labels(spark, folder):
    return ended(spark, folder).select("doc_id", F.md5(F.array_join(P.next_labels(F.col("tokens"), EOS), ",")).alias("labels_md5"))


# rows of up to 64 documents packed one behind the other
PACK = DOC + ", r AS (SELECT doc_id // 8 AS row_id, flatten(list(tokens ORDER BY doc_id)) AS tokens FROM t GROUP BY doc_id // 8)"


def packed(spark, folder):
    """Rows of eight documents each."""
    rows = ended(spark, folder).groupBy(F.floor(F.col("doc_id") / 8).alias("row_id"))
    return rows.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "tokens"))), lambda x: x["tokens"])).alias("tokens"))


@query(PACK + " SELECT row_id, array_to_string(list_sort(list_distinct(generate_series(0, len(tokens), 128) || list_filter(list_transform(generate_series(1, len(tokens)), lambda i: CASE WHEN tokens[i] = 1 THEN i END), lambda x: x IS NOT NULL) || [len(tokens)])), ',') AS cuts FROM r")
def cu_seqlens(spark, folder):
    return packed(spark, folder).select("row_id", F.array_join(P.cut_offsets(F.col("tokens"), 128, EOS), ",").alias("cuts"))


@query(PACK + " SELECT row_id, len(list_distinct(list_transform(generate_series(1, len(tokens)), lambda i: CASE WHEN tokens[i] = 1 THEN i ELSE 0 END)))::BIGINT AS n_cuts FROM r")
def sorted_cuts(spark, folder):
    ends = F.array_distinct(F.transform("tokens", lambda x, i: F.when(x == EOS, i + 1).otherwise(0)))
    return packed(spark, folder).select("row_id", F.size(ends).cast("bigint").alias("n_cuts"))


EACH = DOC + ", e AS (SELECT doc_id // 8 AS row_id, doc_id, unnest(tokens) AS token, unnest(generate_series(0, n)) AS pos FROM t)"


@query(EACH + ", k AS (SELECT row_id, dense_rank() OVER (PARTITION BY row_id ORDER BY doc_id) - 1 AS doc, pos FROM e) SELECT row_id, doc::INT AS doc, max(pos)::INT AS last_pos, count(*)::BIGINT AS n FROM k GROUP BY ALL")
def doc_positions(spark, folder):
    x = packed(spark, folder).select("row_id", F.explode(P.document_positions(F.col("tokens"), EOS)).alias("x"))
    return x.groupBy("row_id", F.col("x.doc").alias("doc")).agg(F.max("x.pos").alias("last_pos"), F.count(F.lit(1)).alias("n"))


@query(EACH + " SELECT row_id, doc_id, count(*)::BIGINT AS n FROM e GROUP BY ALL")
def doc_ids(spark, folder):
    return ended(spark, folder).select(F.floor(F.col("doc_id") / 8).alias("row_id"), "doc_id", F.explode("tokens").alias("t")).groupBy("row_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(DOC + " SELECT doc_id // 8 AS row_id, sum((n + 1) * (n + 2) // 2)::BIGINT AS n_pairs FROM t GROUP BY 1")
def causal_pairs(spark, folder):
    """How many pairs of a token and an earlier one (or itself) of its document there are, counted without listing them."""
    n = F.size("tokens").cast("bigint")
    return ended(spark, folder).groupBy(F.floor(F.col("doc_id") / 8).alias("row_id")).agg(F.sum(F.floor(n * (n + 1) / 2)).alias("n_pairs"))


@query(EACH + ", l AS (SELECT row_id, doc_id, pos, coalesce(lead(token) OVER (PARTITION BY doc_id ORDER BY pos), -100) AS v FROM e) SELECT row_id, md5(string_agg(v::VARCHAR, ',' ORDER BY doc_id, pos)) AS labels_md5 FROM l GROUP BY row_id")
def mtp_labels(spark, folder):
    docs_ = F.transform(P.document_positions(F.col("tokens"), EOS), lambda x: x["doc"])
    return packed(spark, folder).select("row_id", F.md5(F.array_join(P.shift_in_document(F.col("tokens"), docs_, -100), ",")).alias("labels_md5"))


@query(DOC + " SELECT doc_id, unnest(generate_series(0, (n + 63) // 64 - 1))::BIGINT AS chunk FROM t WHERE n > 0")
def chunk_indices(spark, folder):
    return docs(spark, folder).select("doc_id", F.explode(P.chunk_indices(F.size("ids"), 64)).alias("chunk"))


@query(DOC + " SELECT doc_id, round(list_sum(list_transform(generate_series(1, n), lambda i: 0.5 * ids[i] + 0.3 * coalesce(CASE WHEN i > 1 THEN ids[i - 1] END, 0) + 0.2 * coalesce(CASE WHEN i > 2 THEN ids[i - 2] END, 0))), 3) AS total FROM t WHERE n > 0")
def causal_conv(spark, folder):
    conv = P.causal_conv(F.col("ids"), [0.5, 0.3, 0.2])
    return docs(spark, folder).filter(F.size("ids") > 0).select("doc_id", F.round(F.aggregate(conv, F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query(DOC + " SELECT doc_id, md5(array_to_string(list_transform(generate_series(1, n + 1), lambda i: tokens[i] || ':' || coalesce(tokens[i + 1], 65535)), ',')) AS pairs_md5 FROM t")
def paired_sequence(spark, folder):
    p = F.transform(P.paired_sequence(F.col("ids"), EOS), lambda x: F.concat(x["input"], F.lit(":"), x["target"]))
    return docs(spark, folder).select("doc_id", F.md5(F.array_join(p, ",")).alias("pairs_md5"))


@query(DOC + " SELECT doc_id, md5(array_to_string(list_transform(generate_series(1, n - 1), lambda i: ids[i] || ':' || CASE WHEN i - 1 < n // 2 - 1 THEN 65535 ELSE ids[i + 1] END), ',')) AS pairs_md5 FROM t WHERE n > 1")
def sft_mask(spark, folder):
    half = F.floor(F.size("ids") / 2).cast("int")
    m = P.sft_mask(F.slice("ids", F.lit(1), half), F.slice("ids", half + 1, F.size("ids")))
    return docs(spark, folder).filter(F.size("ids") > 1).select("doc_id", F.md5(F.array_join(F.transform(m, lambda x: F.concat(x["input"], F.lit(":"), x["target"])), ",")).alias("pairs_md5"))


@query(DOC + " SELECT doc_id, md5(array_to_string(ids[1:200] || list_transform(generate_series(1, greatest(200 - n, 0)), lambda i: 0), ',')) AS ids_md5 FROM t")
def pad_truncate(spark, folder):
    return docs(spark, folder).select("doc_id", F.md5(F.array_join(P.pad_or_cut(F.col("ids"), 200, 0), ",")).alias("ids_md5"))


FREQ = DOC + ", f AS (SELECT unnest(ids) AS token FROM t), c AS (SELECT token, count(*)::BIGINT AS n FROM f GROUP BY token)"


def frequencies(spark, folder):
    return docs(spark, folder).select(F.explode("ids").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(FREQ + " SELECT token, n FROM c")
def token_freq(spark, folder):
    return frequencies(spark, folder)


@query(FREQ + " SELECT token, n FROM c ORDER BY n DESC, token LIMIT 100")
def top_k_tokens(spark, folder):
    return frequencies(spark, folder).orderBy(F.desc("n"), "token").limit(100)


@query(FREQ + " SELECT min(token) AS lowest, max(token) AS highest, count(*)::BIGINT AS n_distinct FROM c")
def token_id_range(spark, folder):
    return docs(spark, folder).select(F.explode("ids").alias("token")).agg(F.min("token").alias("lowest"), F.max("token").alias("highest"), F.count_distinct("token").alias("n_distinct"))


@query(FREQ + " SELECT max(token) < 60000 AND min(token) >= 0 AS in_domain, sum(n)::BIGINT AS n_tokens FROM c")
def validate_tokens(spark, folder):
    return docs(spark, folder).select(F.explode("ids").alias("token")).agg(((F.max("token") < 60000) & (F.min("token") >= 0)).alias("in_domain"), F.count(F.lit(1)).alias("n_tokens"))


@query(DOC + ", x AS (SELECT (sum(n + 1))::BIGINT AS total FROM t) SELECT 4 AS batch, 32 AS steps, ((total - 1) // 128)::BIGINT AS n_batches, (total // 256)::BIGINT AS n_paired FROM x")
def loader_batches(spark, folder):
    x = docs(spark, folder).agg(F.sum(F.size("ids") + 1).alias("total"))
    return x.select(F.lit(4).alias("batch"), F.lit(32).alias("steps"), F.floor((F.col("total") - 1) / 128).alias("n_batches"), F.floor(F.col("total") / 256).alias("n_paired"))


GRID = "WITH u AS (SELECT shard_id, greatest(0, (n_tokens - 1) // 8192)::BIGINT AS n_units FROM shard_index), g AS (SELECT *, coalesce(sum(n_units) OVER (ORDER BY shard_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_unit FROM u)"


def _grid(spark, folder):
    return P.unit_grid(table(spark, folder, "shard_index"), 8192)


@query(GRID + " SELECT shard_id, n_units, first_unit FROM g")
def unit_grid(spark, folder):
    return _grid(spark, folder)


@query(GRID + " SELECT shard_id, unnest(generate_series(first_unit, first_unit + n_units - 1)) AS unit FROM g WHERE n_units > 0")
def unit_to_shard(spark, folder):
    return P.units(_grid(spark, folder)).select("shard_id", "unit")


EPOCHS = GRID + (
    ", s AS (SELECT shard_id, first_unit, unnest(generate_series(first_unit, first_unit + n_units - 1)) AS unit FROM g WHERE n_units > 0), "
    "p AS (SELECT e.epoch, s.*, row_number() OVER (PARTITION BY e.epoch ORDER BY md5('42-' || e.epoch || '-8192:' || unit)) - 1 AS place, count(*) OVER (PARTITION BY e.epoch) AS total FROM s, (SELECT unnest([0, 1]) AS epoch) e), "
    "w AS (SELECT epoch, (place * 2 + k) // 4 AS batch, (place * 2 + k) % 4 AS row, shard_id, (unit - first_unit) * 8192 + k * 4096 AS start, total * 2 // 4 AS n_batches FROM p, (SELECT unnest([0, 1]) AS k))"
)


@query(EPOCHS + " SELECT epoch::BIGINT AS epoch, batch::BIGINT AS batch, row::BIGINT AS row, shard_id, start::BIGINT AS start FROM w WHERE batch < n_batches")
def epoch_windows(spark, folder):
    """Two epochs, each with its own permutation of the units."""
    return P.windows_of_epochs(_grid(spark, folder), 42, 2, 8192, 4096, 4)


@query(EPOCHS + " SELECT epoch::BIGINT AS epoch, batch::BIGINT AS batch, row::BIGINT AS row, shard_id, start::BIGINT AS start FROM w WHERE batch < n_batches AND (epoch = 1 OR batch >= 7)")
def resume_windows(spark, folder):
    """What is left of two epochs for a reader that stopped before batch 7 of the first one."""
    return P.after_state(P.windows_of_epochs(_grid(spark, folder), 42, 2, 8192, 4096, 4), epoch=0, batch=7)


@query("SELECT coalesce(min_by(eos_id, shard_id), 0) AS eos_id FROM shard_index WHERE shard_id = (SELECT min(shard_id) FROM shard_index)")
def eos_from_sidecar(spark, folder):
    first = table(spark, folder, "shard_index").agg(F.min_by("eos_id", "shard_id").alias("e"))
    return first.select(F.coalesce("e", F.lit(0)).alias("eos_id"))


@query("SELECT run, line, step, CAST(ceil(step / 4.0) * 2 AS BIGINT) AS position FROM train_log")
def stage_switch(spark, folder):
    t = table(spark, folder, "train_log")
    return t.select("run", "line", "step", P.after_stage_switch(F.col("step"), F.lit(4), F.lit(2)).alias("position"))


@query("SELECT unnest([floor(i * 24 / 7.0)::BIGINT for i in range(7)]) AS block")
def spread_selection(spark, folder):
    return spark.range(1).select(F.explode(P.spread_selection(24, 0.3)).alias("block"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, source FROM documents WHERE source IS NOT NULL")
def source_order(spark, folder):
    d = table(spark, folder, "documents").filter("source is not null").select("doc_id", "source")
    return running_rank(d, "source", "doc_id", "k").select("doc_id", "k", "source")


@query("SELECT seq, length(coalesce(nullif(text, ''), nullif(content, ''), nullif(raw_content, ''), ''))::BIGINT AS n FROM raw_docs ORDER BY seq LIMIT 50")
def head_n(spark, folder):
    t = text_fallback(F.col("text"), F.col("content"), F.col("raw_content"))
    return table(spark, folder, "raw_docs").orderBy("seq").limit(50).select("seq", F.length(t).cast("bigint").alias("n"))
