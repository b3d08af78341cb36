"""Queries on sources, sinks, generators, mixing and sampling."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from garimpo.functions.text import canonical_source, text_fallback
from garimpo.operators import mixing as M
from garimpo.operators import packing as P
from garimpo.operators import quality as Q
from garimpo.plans.materialize import materialize, shared_dir
from garimpo.operators.tokenizer import decode
from garimpo.plans.packing_queries import DOC as IDS_SQL
from garimpo.plans.packing_queries import SPILL, docs, placed
from garimpo.plans.pipeline import prepare
from garimpo.plans.prefix import running_offset
from garimpo.plans.registry import query, table, texts
from garimpo.plans.text_queries import EFFECTIVE, sql_legacy
from garimpo.sources import files, generators, shards


def _place(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _local(path):
    return path.removeprefix("file://")


@query("SELECT source, count(*)::BIGINT AS n FROM (SELECT coalesce(source, 'unknown') AS source FROM documents UNION ALL SELECT 'benchmark' FROM benchmark) GROUP BY source")
def union_sources(spark, folder):
    d = table(spark, folder, "documents").select("doc_id", "text", F.coalesce("source", F.lit("unknown")).alias("_source"))
    u = M.union_sources({"documents": d, "benchmark": table(spark, folder, "benchmark").select("item_id", "text")})
    return u.groupBy(F.col("_source").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'documents' AS name, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'raw_docs', count(*)::BIGINT FROM raw_docs")
def source_registry(spark, folder):
    u = M.union_sources({n: table(spark, folder, n).select(F.lit(n).alias("name")) for n in ("documents", "raw_docs")})
    return u.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(rf"SELECT doc_id, n_chars FROM documents WHERE nullif(regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g'), '') = 'pt_hq'")
def scan_documents(spark, folder):
    """One source, in any spelling of its name."""
    return table(spark, folder, "documents").filter(canonical_source(F.col("source")) == "pt_hq").select("doc_id", "n_chars")


@query("SELECT md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL")
def scan_jsonl_field(spark, folder):
    """Written as compressed JSON lines and read back."""
    path = _place(spark, "jsonl")
    table(spark, folder, "documents").filter("text is not null").select("text").write.option("compression", "gzip").json(path)
    return files.jsonl_field(spark, path).select(F.md5("text").alias("text_md5"))


@query("SELECT count(*)::BIGINT AS n, true AS same_folder FROM documents WHERE text IS NOT NULL")
def scan_with_file(spark, folder):
    path = _place(spark, "jsonl")
    table(spark, folder, "documents").filter("text is not null").select("text").write.json(path)
    got = files.jsonl_field(spark, path)
    return got.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.contains("file", F.lit(path.rsplit("/", 1)[1]))).alias("same_folder"))


@query("SELECT shard_id, revision, coalesce(regexp_full_match(revision, '[0-9a-f]{40}'), false) AS pinned FROM (SELECT shard_id, unnest([sha256, left(sha256, 40), left(sha256, 7), upper(left(sha256, 40)), 'main']) AS revision FROM shard_index)")
def sha_pinned(spark, folder):
    """Which of several ways to name a revision pin it: a full lower-case commit hash only."""
    h = F.col("sha256")
    d = table(spark, folder, "shard_index").select("shard_id", F.explode(F.array(h, F.substring(h, 1, 40), F.substring(h, 1, 7), F.upper(F.substring(h, 1, 40)), F.lit("main"))).alias("revision"))
    return d.withColumn("pinned", files.pinned(F.col("revision")))


@query("SELECT run, count(*)::BIGINT AS n, count(loss)::BIGINT AS n_loss FROM train_log GROUP BY run")
def scan_metrics(spark, folder):
    """Log lines written as JSON and read back under a fixed schema."""
    path = _place(spark, "metrics")
    table(spark, folder, "train_log").select("run", "line", "loss").write.json(path)
    return files.metric_lines(spark, path, "run string, line bigint, loss double").groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count("loss").alias("n_loss"))


@query("SELECT shard_id, row_number() OVER (ORDER BY 'shard_' || lpad(shard_id::VARCHAR, 5, '0')) AS place FROM shard_index")
def shard_order(spark, folder):
    """One row a shard."""
    s = table(spark, folder, "shard_index").select("shard_id", F.format_string("shard_%05d", "shard_id").alias("path"))
    return s.select("shard_id", F.row_number().over(W.orderBy("path")).alias("place"))


@query("SELECT shard_id, coalesce(dtype = 'uint32', false) AND n_tokens > 0 AS valid FROM shard_index")
def sidecar_check(spark, folder):
    return table(spark, folder, "shard_index").select("shard_id", (F.coalesce(F.col("dtype") == "uint32", F.lit(False)) & (F.col("n_tokens") > 0)).alias("valid"))


@query(SPILL + ", f AS (SELECT shard_id, unnest((ids || [1::BIGINT])[frm + 1:frm + n_part]) AS t FROM p) SELECT shard_id::INT AS shard_id, count(*)::BIGINT AS n_tokens, sum(t)::BIGINT AS id_sum FROM f GROUP BY shard_id")
def shard_round_trip(spark, folder):
    """Shards written in the binary format and read back."""
    path = _local(_place(spark, "shards"))
    t = P.shard_tokens(P.shard_parts(placed(spark, folder), 4096), "ids", 1).withColumn("shard_id", F.col("shard_id").cast("int"))
    shards.write_shards(t, path, 1, 1024)
    got = shards.read_shards(spark, path, block="1024")
    return got.groupBy(F.regexp_extract("path", r"shard_(\d+)", 1).cast("int").alias("shard_id")).agg(F.sum(F.size("tokens")).alias("n_tokens"), F.sum(F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("id_sum"))


def _sql_list(words):
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def _sql_pick(words, step):
    return f"{_sql_list(words)}[({step}) % {len(words)} + 1]"


def _sql_mock(kind, k):
    if kind == "code":
        n = "(range * 12 + j)"
        name, over, sign = (_sql_pick(w, f"{n} // {d}") for w, d in zip(generators.CODE, (1, 2, 3)))
        one, sep = f"'def f' || {n} || '(' || {over} || '):\n    ' || {name} || ' = 0\n    for x in ' || {over} || ':\n        ' || {name} || ' = ' || {name} || ' ' || {sign} || ' x\n    return ' || {name} || '\n'", "chr(10)"
    else:
        n = "(range * 7 + j)"
        one, sep = " || ' ' || ".join(_sql_pick(w, f"{n} // {d}") for w, d in zip(generators.PHRASES[kind], (1, 2, 3))) + " || '.'", "' '"
    whole = f"md5(array_to_string(list_transform(generate_series(0, 11), lambda j: {one}), {sep}))"
    return f"SELECT range * 4 + {k} AS seq, '{kind}' AS source, {whole} AS text_md5, {str(kind == 'code').lower()} AS in_content FROM range(500)"


@query(" UNION ALL ".join(_sql_mock(kind, k) for k, kind in enumerate([*generators.PHRASES, "code"])))
def mock_sources(spark, folder):
    """500 made-up records of each of four kinds; code stands under another key."""
    m = generators.mock_records(spark, 500)
    return m.select("seq", F.col("_source").alias("source"), F.md5(F.coalesce("text", "content")).alias("text_md5"), F.col("content").isNotNull().alias("in_content"))


@query("SELECT range AS id, 'Quanto é ' || range || ' + ' || range * 3 || ' - ' || range % 7 || '?' AS prompt, (range * 4 - range % 7)::VARCHAR AS chosen, (range * 4 + range % 7)::VARCHAR AS rejected FROM range(500)")
def preference_samples(spark, folder):
    i = F.col("id")
    return spark.range(500).select("id", F.concat(F.lit("Quanto é "), i, F.lit(" + "), i * 3, F.lit(" - "), i % 7, F.lit("?")).alias("prompt"), (i * 4 - i % 7).cast("string").alias("chosen"), (i * 4 + i % 7).cast("string").alias("rejected"))


@query("WITH l AS (SELECT range AS doc, 8 + ('0x' || substr(md5(range::VARCHAR), 1, 6))::BIGINT % 593 AS n FROM range(200)) SELECT doc, n, list_sum(list_transform(generate_series(0, n - 2), lambda i: (doc * 7 + i * 3) % 99 + 2))::BIGINT + 1 AS id_sum FROM l")
def synthetic_shard(spark, folder):
    n = 8 + F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 6), 16, 10).cast("bigint") % 593
    d = spark.range(200).select(F.col("id").alias("doc"), n.alias("n"))
    ids = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 2), lambda i: (F.col("doc") * 7 + i * 3) % 99 + 2)
    return d.select("doc", "n", (F.aggregate(ids, F.lit(0).cast("bigint"), lambda a, x: a + x) + 1).alias("id_sum"))


@query(f"WITH {sql_legacy('seq', EFFECTIVE, 'true', 'raw_docs')} SELECT seq FROM legacy WHERE passed")
def pt_quality_stream(spark, folder):
    """Effective texts that pass the legacy filter for Portuguese."""
    t = text_fallback(F.col("text"), F.col("content"), F.col("raw_content"))
    return Q.keep(texts(spark, folder, "raw_docs").select("seq", t.alias("text")), Q.legacy_quality(F.col("text"), F.lit(True))).select("seq")


@query(f"WITH {sql_legacy('doc_id', 'text', 'false', 'documents')} SELECT doc_id FROM legacy LEFT JOIN embeddings ON vec_id = doc_id WHERE passed AND coalesce(label >= 3, true)")
def edu_quality_stream(spark, folder):
    """Texts whose score is 3 or more, or missing, that pass the legacy filter; the score is the label of the vector with the document's number."""
    scores = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("score"))
    d = texts(spark, folder, "documents").select("doc_id", "text").join(scores, "doc_id", "left")
    return Q.keep(d.filter(Q.score_filter(F.col("score"))), Q.legacy_quality(F.col("text"), F.lit(False))).select("doc_id")


TURNS = "WITH o AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events)"


@query(TURNS + " SELECT a.user_id, a.turn, a.event_id AS prompt_id, a.event_type AS prompt, b.event_id AS response_id, b.event_type AS response FROM o a JOIN o b ON a.user_id = b.user_id AND b.turn = a.turn + 1")
def prompt_response_pairs(spark, folder):
    """Each event of a user (prompt) with the user's next one (response), over all rows."""
    o = table(spark, folder, "events").select("user_id", "event_id", "event_type", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("turn"))
    a = o.select("user_id", "turn", F.col("event_id").alias("prompt_id"), F.col("event_type").alias("prompt"))
    b = o.select("user_id", (F.col("turn") - 1).alias("turn"), F.col("event_id").alias("response_id"), F.col("event_type").alias("response"))
    return a.join(b, ["user_id", "turn"])


@query(TURNS + " SELECT a.user_id, a.turn, a.event_type || '>' || b.event_type AS pair FROM o a JOIN o b ON a.user_id = b.user_id AND b.turn = a.turn + 1")
def sft_pairs(spark, folder):
    """Each turn with the next one of its conversation, by an equi-join on (conversation, turn)."""
    o = table(spark, folder, "events").select("user_id", "event_type", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("turn"))
    a, b = o.withColumnRenamed("event_type", "p"), o.select("user_id", (F.col("turn") - 1).alias("turn"), F.col("event_type").alias("r"))
    return a.join(b, ["user_id", "turn"]).select("user_id", "turn", F.concat("p", F.lit(">"), "r").alias("pair"))


@query("SELECT source, 1.0 / count(*) OVER () AS weight FROM (SELECT DISTINCT source FROM mix_targets)")
def uniform_weights(spark, folder):
    names = [r[0] for r in table(spark, folder, "mix_targets").select("source").distinct().collect()]
    return spark.createDataFrame(list(M.check_weights(names, None).items()), "source string, weight double")


CANONICAL = r"nullif(regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g'), '')"


def _mixable(spark, folder):
    """Documents of all sources of ``mix_targets`` under their canonical names, and their weights."""
    name = canonical_source(F.col("source")).alias("source")
    weights = dict(table(spark, folder, "mix_targets").select(name, "weight").collect())
    d = table(spark, folder, "documents").select("doc_id", name)
    return d.filter(F.col("source").isin(list(weights))), weights


@query(f"SELECT doc_id, d.source, round(row_number() OVER (PARTITION BY d.source ORDER BY doc_id) / weight, 6) AS pace FROM (SELECT doc_id, {CANONICAL} AS source FROM documents) d JOIN (SELECT {CANONICAL} AS source, weight FROM mix_targets) m ON m.source = d.source")
def weighted_mix(spark, folder):
    d, weights = _mixable(spark, folder)
    return M.interleave(d, "source", "doc_id", weights).select("doc_id", "source", F.round("pace", 6).alias("pace"))


@query()
def weighted_draws(spark, folder):
    d, weights = _mixable(spark, folder)
    return M.draw(d, "source", "doc_id", weights)


@query("SELECT doc_id, n_chars FROM documents ORDER BY md5('0:' || doc_id), doc_id LIMIT 100")
def reservoir(spark, folder):
    return M.sample(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id", 100)


@query("SELECT shard_id, md5('42-0-8192:' || shard_id) AS rank_key FROM shard_index")
def epoch_permutation(spark, folder):
    return M.permutation(table(spark, folder, "shard_index"), "shard_id", "42-0-8192").select("shard_id", "rank_key")


def _prepared(spark, folder):
    return prepare(texts(spark, folder, "raw_docs"), 1 << 40, 8192)  # the budget of ``python -m garimpo``: no table reaches it


@query()
def pipeline_stats(spark, folder):
    """Counters of the whole preparation."""
    return _prepared(spark, folder).stats()


@query("SELECT true AS some, 0::BIGINT AS n_different")
def pipeline_decodes(spark, folder):
    """The preparation of the sources of ``mix_targets`` in their mixture under the byte-level tokenizer: do its ids spell the texts?"""
    v, m = table(spark, folder, "vocab"), table(spark, folder, "merges")
    _, weights = _mixable(spark, folder)
    raw = texts(spark, folder, "raw_docs")
    made = prepare(raw, 1 << 40, 1 << 20, tokenizer=(v, m), weights=weights, capacity=10_000)
    back = decode(made.documents.select("seq", "ids"), v)
    want = made.cleaned.select("seq", F.col("text").alias("before"))
    return back.join(want, "seq").agg((F.count(F.lit(1)) > 0).alias("some"), F.count_if(~F.col("text").eqNullSafe(F.col("before"))).alias("n_different"))


PAIRS = IDS_SQL + " , p AS (SELECT unnest(tokens) AS i, unnest(list_transform(generate_series(1, n + 1), lambda k: coalesce(tokens[k + 1], 65535))) AS o FROM t)"


@query(PAIRS + " SELECT count(*)::BIGINT AS n_pairs, sum(i)::BIGINT AS input_sum, sum(o)::BIGINT AS target_sum FROM p")
def paired_round_trip(spark, folder):
    """Pairs of tokens and targets as 16-bit shards, written in two runs of which the second goes on behind the first."""
    path = _local(_place(spark, "pairs"))
    p = P.paired_sequence(F.col("ids"), 1)
    d = docs(spark, folder).select("doc_id", F.flatten(F.transform(p, lambda x: F.array(x["input"], x["target"]))).alias("tokens"))
    placed = running_offset(d, "doc_id", F.size("tokens")).withColumn("shard_id", F.floor(F.col("off") / 65_536).cast("int"))
    placed = materialize(placed.withColumn("shard_pos", F.col("off") - F.min("off").over(W.partitionBy("shard_id"))).select("shard_id", "shard_pos", "tokens"), "paired")  # a shard has a fixed size
    half = (placed.agg(F.max("shard_id")).first()[0] or 0) // 2
    shards.append_shards(placed.filter(F.col("shard_id") <= half), path, 1, 1024, "uint16")
    shards.append_shards(placed.filter(F.col("shard_id") > half).withColumn("shard_id", F.col("shard_id") - half - 1), path, 1, 1024, "uint16")
    got = shards.read_shards(spark, path, dtype="uint16", block="1024")
    one = got.select("path", F.posexplode("tokens").alias("k", "t"))
    return one.agg(F.count_if(F.col("k") % 2 == 0).alias("n_pairs"), F.sum(F.when(F.col("k") % 2 == 0, F.col("t"))).alias("input_sum"), F.sum(F.when(F.col("k") % 2 == 1, F.col("t"))).alias("target_sum"))


@query()
def pipeline_shards(spark, folder):
    """Tokens of each shard of the whole preparation, in all and by source."""
    listed = F.array_join(F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return _prepared(spark, folder).sidecars(1024).select("shard_id", "n_tokens", listed.alias("sources"))
