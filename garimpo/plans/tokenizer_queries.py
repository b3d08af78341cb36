"""Queries on the byte-level tokenizer, sampling from frequencies, synthetic batches and configurations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from garimpo.functions.text import chat_template, strip, whitespace_words
from garimpo.operators import config as C
from garimpo.operators import mixing as M
from garimpo.operators import tokenizer as T
from garimpo.operators import vocabulary as V
from garimpo.plans.materialize import materialize
from garimpo.plans.packing_queries import FREQ, frequencies
from garimpo.plans.prefix import running_offset, running_rank
from garimpo.plans.registry import query, table, texts
from garimpo.plans.source_queries import CANONICAL
from garimpo.plans.text_queries import WORDS
from garimpo.plans.vocabulary_queries import selected


def _tokenizer(spark, folder):
    return table(spark, folder, "vocab"), table(spark, folder, "merges")


@query("SELECT doc_id, true AS same FROM documents")
def bpe_round_trip(spark, folder):
    """Every text encoded and decoded again."""
    v, m = _tokenizer(spark, folder)
    d = texts(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("before"), F.coalesce("text", F.lit("")).alias("text"))
    return T.decode(T.encode(d, v, m), v).select("doc_id", (F.col("before") == F.col("text")).alias("same"))


@query()
def bpe_encode(spark, folder):
    return T.encode(texts(spark, folder, "documents").select("doc_id", "text"), *_tokenizer(spark, folder)).select("doc_id", F.size("ids").alias("n_tokens"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


_CODE = "unicode(c)"


@query(f"SELECT token, array_to_string(list_transform(string_split(token, ''), lambda c: printf('%02X', CASE WHEN {_CODE} < 256 THEN {_CODE} WHEN {_CODE} <= 288 THEN {_CODE} - 256 WHEN {_CODE} <= 322 THEN {_CODE} - 162 ELSE 173 END)), '') AS bytes FROM vocab")
def token_bytes(spark, folder):
    return table(spark, folder, "vocab").select("token", T.token_bytes(F.col("token")).alias("bytes"))


@query("SELECT id, piece, chr(id::INT) AS text FROM (SELECT range AS id, printf('<0x%02X>', range) AS piece FROM range(1, 256)) UNION ALL SELECT 1000 + id, token, token FROM vocab")
def byte_pieces(spark, folder):
    """The 255 byte pieces other than zero, and the plain tokens of the vocabulary, as text."""
    b = spark.range(1, 256).select("id", F.format_string("<0x%02X>", "id").alias("piece"))
    v = table(spark, folder, "vocab").select((F.col("id") + 1000).cast("bigint").alias("id"), F.col("token").alias("piece"))
    return b.unionByName(v).withColumn("text", T.piece_text(F.col("piece")))


@query("SELECT merge_rank, left_token || right_token AS token, id FROM merges LEFT JOIN vocab ON token = left_token || right_token")
def merge_results(spark, folder):
    m = table(spark, folder, "merges").select("merge_rank", T.merged_text(F.col("left_token"), F.col("right_token")).alias("token"))
    return m.join(table(spark, folder, "vocab"), "token", "left").select("merge_rank", "token", "id")


def _fertility(spark, folder, vocab, merges):
    d = texts(spark, folder, "documents").select(F.coalesce("source", F.lit("unknown")).alias("source"), F.size(whitespace_words(F.col("text"))).alias("n_words"), "text").filter("n_words > 0")
    return T.count_tokens(d, vocab, merges)


@query()
def fertility(spark, folder):
    """Tokens a word of each source under the vocabulary; blank texts don't count."""
    by = _fertility(spark, folder, *_tokenizer(spark, folder)).groupBy("source")
    return by.agg(F.sum("n_words").alias("n_words"), F.sum("n_tokens").alias("n_tokens"), F.round(V.fertility(F.col("n_tokens"), F.col("n_words")), 6).alias("fertility"))


@query()
def fertility_gate(spark, folder):
    """The vocabulary against the one selected from it, over the same texts."""
    v, m = _tokenizer(spark, folder)
    keep = selected(spark, folder)
    base = _fertility(spark, folder, v, m).withColumn("pruned", F.lit(False))
    less = _fertility(spark, folder, keep, V.pruned_merges(m, keep)).withColumn("pruned", F.lit(True))
    x = base.unionByName(less).agg(*(V.fertility(F.when(F.col("pruned") == p, F.col("n_tokens")), F.when(F.col("pruned") == p, F.col("n_words"))).alias(n) for p, n in ((False, "base"), (True, "less"))))
    g = V.fertility_gate(F.col("base"), F.col("less"))
    return x.select("base", "less", g.alias("g")).select("base", "less", F.round("g.ratio", 6).alias("ratio"), F.round("g.degradation", 6).alias("degradation"), F.col("g.passed").alias("passed"))


TOP_P = FREQ + (
    ", k AS (SELECT token, n FROM c ORDER BY n DESC, token LIMIT 200), p AS (SELECT token, n / sum(n) OVER () AS p, coalesce(sum(n) OVER (ORDER BY n DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER () AS before FROM k)"
)


@query(TOP_P + " SELECT token, round(p, 9) AS p FROM p WHERE before < 0.6")
def top_p_cut(spark, folder):
    """Of the 200 most frequent tokens, the fewest that make up 0.6 of their occurrences."""
    return M.nucleus(frequencies(spark, folder), "token", "n", 200, 0.6).select("token", F.round("p", 9).alias("p"))


@query("SELECT e.epoch::BIGINT AS epoch, doc_id, row_number() OVER (PARTITION BY e.epoch ORDER BY md5('42-' || e.epoch || ':' || doc_id)) AS place FROM documents, (SELECT unnest([0, 1, 2]) AS epoch) e")
def pool_shuffle(spark, folder):
    """Three passes over the pool, each in an order of its own."""
    return M.passes(table(spark, folder, "documents").select("doc_id"), "doc_id", 42, 3)


_DRAWS = 20_000
ENDLESS = (
    f"WITH w AS (SELECT {CANONICAL} AS source, weight, sum(weight) OVER (ORDER BY {CANONICAL}) AS upto, sum(weight) OVER () AS whole FROM mix_targets), "
    f"d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS size FROM (SELECT doc_id, {CANONICAL} AS source FROM documents) WHERE source IN (SELECT source FROM w)), "
    f"s AS (SELECT range AS step, ('0x' || substr(md5('42:' || range), 1, 8))::BIGINT / 4294967296 AS u FROM range({_DRAWS})), "
    "t AS (SELECT step, (SELECT min_by(source, upto) FROM w WHERE upto / whole > u) AS source FROM s), r AS (SELECT step, source, row_number() OVER (PARTITION BY source ORDER BY step) AS j FROM t)"
)


@query(ENDLESS + " SELECT step, r.source, doc_id FROM r JOIN d ON d.source = r.source AND d.k = (r.j - 1) % d.size + 1")
def endless_mix(spark, folder):
    """The first 20,000 draws of an endless interleaving: a source that is used up starts again."""
    name = F.nullif(F.regexp_replace(F.lower(F.trim("source")), r"[\s\-]+", "_"), F.lit("")).alias("source")
    weights = dict(table(spark, folder, "mix_targets").select(name, "weight").collect())
    return M.endless(table(spark, folder, "documents").select("doc_id", name), "source", "doc_id", weights, _DRAWS, 42)


@query("WITH d AS (SELECT seq AS id, row_number() OVER (ORDER BY seq) AS k FROM raw_docs), s AS (SELECT range AS step, ('0x' || substr(md5('7:' || range), 1, 8))::BIGINT % 2 AS real, sum(('0x' || substr(md5('7:' || range), 1, 8))::BIGINT % 2) OVER (ORDER BY range) AS j FROM range(20000)) SELECT step, CASE WHEN real = 1 THEN id END AS seq, coalesce(real = 0 OR id IS NULL, true) AS made FROM s LEFT JOIN d ON real = 1 AND d.k = s.j")
def real_blend(spark, folder):
    """Half real records in order, half generated ones; generated ones also when the real ones are used up."""
    return M.blend(table(spark, folder, "raw_docs").select("seq"), "seq", 20_000, 7)


_LENGTHS = (
    "WITH d AS (SELECT n_chars AS n, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS size FROM documents WHERE n_chars > 0), i AS (SELECT range AS i, ('0x' || substr(md5('7:' || range), 1, 8))::BIGINT AS h FROM range(50000)), "
    "x AS (SELECT i, n FROM i JOIN d ON d.k = h % size), o AS (SELECT i, n, coalesce(sum(n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM x)"
)


@query(_LENGTHS + " SELECT i, least(n, 50000 - off)::BIGINT AS n FROM o WHERE off < 50000")
def sample_lengths(spark, folder):
    """Lengths of documents drawn with replacement until they make exactly 50,000; the last one is cut."""
    d = table(spark, folder, "documents").filter("n_chars > 0").select("doc_id", F.col("n_chars").alias("n"))
    return M.draw_lengths(d, "doc_id", "n", 50_000, "7")


BATCH = (
    "WITH r AS (SELECT range AS row, list_transform(generate_series(0, 127), lambda i: ('0x' || substr(md5(range || ':' || i), 1, 8))::BIGINT % 1000) AS t, "
    "list_sort(list_distinct(list_transform([0, 1, 2], lambda j: 1 + ('0x' || substr(md5(range || '-' || j), 1, 8))::BIGINT % 127))) AS c FROM range(64))"
)


@query(BATCH + " SELECT row, array_to_string(c, ',') AS cuts, md5(array_to_string(list_transform(generate_series(1, 128), lambda i: CASE WHEN i = 128 OR list_contains(c, i) THEN -100 ELSE t[i + 1] END), ',')) AS labels_md5 FROM r")
def synthetic_batch(spark, folder):
    """64 rows of 128 made-up tokens in up to four documents each; no label crosses a document's end."""
    return M.synthetic_batch(spark, 64, 128, 1000, 3).select("row", F.array_join("cuts", ",").alias("cuts"), F.md5(F.array_join("labels", ",")).alias("labels_md5"))


_PROMPT, _RESPONSE = "coalesce(nullif(trim(text), ''), nullif(trim(content), ''))", "coalesce(nullif(trim(raw_content), ''), nullif(trim(content), ''))"


@query(f"SELECT seq, md5('<|user|>\n' || p || '\n<|assistant|>\n') AS prompt_md5, md5(r || '\n<|endoftext|>\n') AS response_md5 FROM (SELECT seq, {_PROMPT} AS p, {_RESPONSE} AS r FROM raw_docs) WHERE p IS NOT NULL AND r IS NOT NULL AND p <> r")
def instruction_pairs(spark, folder):
    """Prompts and responses under their first key that holds anything, in the chat template; half-empty pairs are left out."""

    def first(*names):
        return F.coalesce(*(F.nullif(F.trim(F.col(n)), F.lit("")) for n in names))

    d = table(spark, folder, "raw_docs").select("seq", first("text", "content").alias("p"), first("raw_content", "content").alias("r")).filter("p is not null and r is not null and p <> r")
    q, a = chat_template(F.col("p"), F.col("r"))
    return d.select("seq", F.md5(q).alias("prompt_md5"), F.md5(a).alias("response_md5"))


_MODEL = C.Model(width=1024, ffn=2816, vocab=65_536, attention_layers=6, heads=8, kv_heads=2, head_size=128, linear_layers=18, linear_qk_heads=8, linear_v_heads=16, linear_head_size=64, extra_heads=1)
_PER_LAYER = "3 * 1024 * 8 * 128 + 2 * 1024 * 2 * 128", "1024 * (2 * 8 * 64 + 3 * 16 * 64 + 2 * 16)", "3 * 1024 * 2816"
_FLOPS = "6.0 * (7 * ({0} + {2}) + 18 * ({1} + {2}) + 2 * 1024 * 1024 + 2 * 65536 * 1024 + 2 * 18 * 16 * 64 * 64 + 7 * 8 * 128 * seq_len)".format(*_PER_LAYER)
LOG = "WITH g AS (SELECT * FROM train_log QUALIFY row_number() OVER (PARTITION BY run, line ORDER BY received_at) = 1)"


@query(LOG + f" SELECT run, line, {_FLOPS} AS flops, round({_FLOPS} * tok_s / 165e12, 6) AS mfu FROM g")
def mfu(spark, folder):
    from garimpo.operators import runlog

    g = runlog.first_received(table(spark, folder, "train_log"))
    return g.select("run", "line", _MODEL.flops(F.col("seq_len")).alias("flops"), F.round(_MODEL.utilization(F.col("seq_len"), F.col("tok_s"), 165.0), 6).alias("mfu"))


_SETTINGS = "SELECT shard_id, unnest(['dtype', 'eos_id', 'unit_len', 'n_tokens', 'sha256']) AS name, unnest([dtype, eos_id::VARCHAR, unit_len::VARCHAR, n_tokens::VARCHAR, sha256]) AS value FROM shard_index"


@query(f"WITH s AS ({_SETTINGS}) SELECT a.shard_id, a.name, a.value AS saved, b.value AS current FROM s a JOIN s b ON b.shard_id = a.shard_id + 1 AND b.name = a.name WHERE a.name <> 'sha256' AND a.value IS DISTINCT FROM b.value")
def config_diff(spark, folder):
    """Settings of each sidecar that the next one changes; its checksum always differs and doesn't count."""
    names = ["dtype", "eos_id", "unit_len", "n_tokens", "sha256"]
    s = table(spark, folder, "shard_index").select("shard_id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names))).alias("x")).select("shard_id", "x.name", "x.value")
    after = s.withColumn("shard_id", F.col("shard_id") - 1)
    whole = s.select("shard_id").distinct().join(after.select("shard_id").distinct(), "shard_id")
    return C.differences(s.join(whole, "shard_id"), after.join(whole, "shard_id"), "shard_id", ["sha256"])


@query("SELECT run, coalesce(bool_and(seq_len >= before), true) AS ok FROM (SELECT run, seq_len, lag(seq_len) OVER (PARTITION BY run ORDER BY first) AS before FROM (SELECT run, seq_len, min(line) AS first FROM train_log GROUP BY ALL)) GROUP BY run")
def stages_rise(spark, folder):
    """Whether the lengths of each run's stages only rise, in the order in which they begin."""
    s = table(spark, folder, "train_log").groupBy("run", "seq_len").agg(F.min("line").alias("first"))
    return C.rising(s, "run", "first", "seq_len")
