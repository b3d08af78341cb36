"""Queries on texts: fallbacks, words, n-grams, cleaning, quality filters, exact and near duplicates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from garimpo.functions import text as X
from garimpo.operators import dedup as D
from garimpo.operators import quality as Q
from garimpo.plans.materialize import materialize
from garimpo.plans.registry import query, table, texts

WS = X.WS
STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS_PT) + "]"
# Pieces of SQL shared by the oracles


def WORDS(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '{WS}+'), lambda x: x <> '')"


def TOKENS(c: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}_]+')"


def LINES(c: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(lower(coalesce({c}, '')), '{X.LINE_BREAK}'), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '')"


EFFECTIVE = "coalesce(nullif(text, ''), nullif(content, ''), nullif(raw_content, ''), '')"
IS_PT = """coalesce({flag}, CASE WHEN regexp_matches(lower({s}), '^(pt_|pt-|por_)') OR lower({s}) = 'pt' OR contains(lower({s}), '_pt_') OR regexp_matches(lower({s}), '(_pt|-pt)$') THEN true
  WHEN contains(lower({s}), 'en') OR contains(lower({s}), 'code') OR contains(lower({s}), 'math') OR contains(lower({s}), 'python') THEN false ELSE true END)"""


def _docs(spark, folder):
    return texts(spark, folder, "documents")


def _raw(spark, folder):
    return texts(spark, folder, "raw_docs")


@query(f"SELECT seq, md5({EFFECTIVE}) AS text_md5, length({EFFECTIVE})::BIGINT AS n_chars FROM raw_docs")
def text_fallback(spark, folder):
    t = X.text_fallback(F.col("text"), F.col("content"), F.col("raw_content"))
    return _raw(spark, folder).select("seq", F.md5(t).alias("text_md5"), F.length(t).cast("bigint").alias("n_chars"))


@query("SELECT seq, coalesce(_source, source, 'unknown') AS source FROM raw_docs")
def source_fallback(spark, folder):
    return _raw(spark, folder).select("seq", X.source_fallback(F.col("_source"), F.col("source")).alias("source"))


@query(f"WITH r AS (SELECT seq, is_pt AS flag, coalesce(_source, source, 'unknown') AS s FROM raw_docs) SELECT seq, {IS_PT.format(flag='flag', s='s')} AS is_pt FROM r")
def resolve_is_pt(spark, folder):
    s = X.source_fallback(F.col("_source"), F.col("source"))
    return _raw(spark, folder).select("seq", X.resolve_is_pt(F.col("is_pt"), s).alias("is_pt"))


@query(f"SELECT doc_id, len({WORDS('text')})::BIGINT AS n_words, md5(array_to_string({WORDS('text')}, ' ')) AS words_md5 FROM documents")
def whitespace_words(spark, folder):
    w = X.whitespace_words(F.col("text"))
    return _docs(spark, folder).select("doc_id", F.size(w).cast("bigint").alias("n_words"), F.md5(F.array_join(w, " ")).alias("words_md5"))


@query(f"SELECT doc_id, len({TOKENS('text')})::BIGINT AS n_tokens, md5(array_to_string({TOKENS('text')}, ' ')) AS tokens_md5 FROM documents")
def word_tokens(spark, folder):
    w = X.word_tokens(F.col("text"))
    return _docs(spark, folder).select("doc_id", F.size(w).cast("bigint").alias("n_tokens"), F.md5(F.array_join(w, " ")).alias("tokens_md5"))


@query(
    f"WITH w AS (SELECT doc_id, {WORDS('text')} AS w FROM documents), g AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN w ELSE "
    "list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' ')) END AS g FROM w) SELECT doc_id, len(g)::BIGINT AS n_shingles, md5(array_to_string(g, '|')) AS shingles_md5 FROM g"
)
def word_shingles(spark, folder):
    g = X.n_grams(X.whitespace_words(F.col("text")), 5)
    return _docs(spark, folder).select("doc_id", F.size(g).cast("bigint").alias("n_shingles"), F.md5(F.array_join(g, "|")).alias("shingles_md5"))


@query(f"SELECT doc_id, md5(array_to_string({WORDS('lower(text)')}, ' ')) AS text_md5 FROM documents")
def normalize_text(spark, folder):
    return _docs(spark, folder).select("doc_id", F.md5(X.normalize(F.col("text"))).alias("text_md5"))


@query(
    f"WITH n AS (SELECT doc_id, array_to_string({WORDS('lower(text)')}, ' ') AS t FROM documents) SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE "
    "len(list_distinct(list_transform(generate_series(1, greatest(length(t) - 4, 1)), lambda i: substring(t, i, 5)))) END::BIGINT AS n_shingles FROM n"
)
def char_shingles(spark, folder):
    return _docs(spark, folder).select("doc_id", F.size(X.char_shingles(X.normalize(F.col("text")))).cast("bigint").alias("n_shingles"))


_MARKUP = r"regexp_replace(regexp_replace(regexp_replace({}, '(?i)<script[\s\S]*?</script>|<style[\s\S]*?</style>', '', 'g'), '<!--[\s\S]*?-->', '', 'g'), '<[^>]+>', ' ', 'g')"


@query(f"SELECT seq, md5({_MARKUP.format(EFFECTIVE)}) AS text_md5 FROM raw_docs")
def drop_markup(spark, folder):
    t = X.text_fallback(F.col("text"), F.col("content"), F.col("raw_content"))
    return _raw(spark, folder).select("seq", F.md5(X.drop_markup(t)).alias("text_md5"))


def _sql_tidy(c: str) -> str:
    c = f"replace({c}, chr(160), ' ')"
    for pattern, by in (
        (r"\[!\[[^\n]*?\]\([^\n]*?\)\]\([^\n]*?\)", ""), (r"!\[[^\n]*?\]\([^\n]*?\)", ""), (X.LINE_BREAK, "\n"), (X.HSPACE + "+", " "), (" ?\n ?", "\n"), ("\n{3,}", "\n\n"), (f"^{WS}+|{WS}+$", ""),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return c


def _sql_unescape(c: str) -> str:
    # the entities that the test texts hold; the engine decodes all
    for name, value in (("&mdash;", 8212), ("&ndash;", 8211), ("&nbsp;", 160), ("&quot;", 34), ("&#64;", 64), ("&#39;", 39), ("&hellip;", 8230), ("&lt;", 60), ("&gt;", 62), ("&amp;", 38)):
        c = f"replace({c}, '{name}', chr({value}))"
    return c


CLEAN = _sql_tidy(_sql_unescape(_MARKUP.format("coalesce({}, '')")))


def sql_clean(column: str) -> str:
    return CLEAN.replace("coalesce({}, '')", f"coalesce({column}, '')")


@query(f"SELECT seq, md5({sql_clean(EFFECTIVE)}) AS text_md5, length({sql_clean(EFFECTIVE)})::BIGINT AS n_chars FROM raw_docs")
def clean_boilerplate(spark, folder):
    d = _raw(spark, folder).select("seq", X.clean_boilerplate(X.text_fallback(F.col("text"), F.col("content"), F.col("raw_content"))).alias("t"))
    return d.select("seq", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("n_chars"))


@query(f"SELECT doc_id, length(coalesce(text, '')) >= 150 AND len({WORDS('text')}) >= 30 AS passed FROM documents")
def filter_length(spark, folder):
    return _docs(spark, folder).select("doc_id", Q.long_enough(F.coalesce("text", F.lit(""))).alias("passed"))


_ALPHA = r"length(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g')) / nullif(length({0}), 0)::DOUBLE"


@query(f"SELECT doc_id, round({_ALPHA.format('text')}, 6) AS density, coalesce({_ALPHA.format('text')} >= 0.7, false) AS passed FROM documents")
def filter_alpha_density(spark, folder):
    d = Q.alpha_density(F.col("text"))
    return _docs(spark, folder).select("doc_id", F.round(d, 6).alias("density"), F.coalesce(d >= 0.7, F.lit(False)).alias("passed"))


_REPEATED = "CASE WHEN len(l) <= 1 THEN 0.0 ELSE (len(l) - len(list_filter(list_distinct(l), lambda u: len(list_filter(l, lambda v: v = u)) = 1)))::DOUBLE / len(l) END"


@query(f"WITH x AS (SELECT doc_id, {LINES('text')} AS l FROM documents) SELECT doc_id, round({_REPEATED}, 6) AS share, {_REPEATED} <= 0.3 AS passed FROM x")
def filter_line_repetition(spark, folder):
    r = Q.repeated_line_share(F.col("text"))
    return _docs(spark, folder).select("doc_id", F.round(r, 6).alias("share"), (r <= 0.3).alias("passed"))


@query(f"WITH x AS (SELECT doc_id, unnest({LINES('text')}) AS l FROM documents), c AS (SELECT doc_id, l, count(*) AS n FROM x GROUP BY ALL) SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*)::BIGINT AS n_distinct, max(n)::BIGINT AS most FROM c GROUP BY doc_id")
def line_counts(spark, folder):
    x = _docs(spark, folder).select("doc_id", F.explode(X.lines(F.col("text"))).alias("l")).groupBy("doc_id", "l").agg(F.count(F.lit(1)).alias("n"))
    return x.groupBy("doc_id").agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_distinct"), F.max("n").alias("most"))


_NGRAMS = "CASE WHEN len(w) < 5 THEN 0.0 ELSE 1 - len(list_distinct(g))::DOUBLE / len(g) END"
_NGRAM_CTE = f"WITH w AS (SELECT doc_id, {TOKENS('text')} AS w FROM documents), g AS (SELECT doc_id, w, list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' ')) AS g FROM w) "


@query(_NGRAM_CTE + f"SELECT doc_id, round({_NGRAMS}, 6) AS share, {_NGRAMS} <= 0.2 AS passed FROM g")
def filter_ngram_repetition(spark, folder):
    r = Q.repeated_ngram_share(F.col("text"))
    return _docs(spark, folder).select("doc_id", F.round(r, 6).alias("share"), (r <= 0.2).alias("passed"))


@query(f"SELECT doc_id, len(list_filter({TOKENS('text')}, lambda w: list_contains({STOP}, w)))::BIGINT AS n_stopwords FROM documents")
def filter_pt_stopwords(spark, folder):
    return _docs(spark, folder).select("doc_id", Q.stopword_count(F.col("text")).cast("bigint").alias("n_stopwords"))


@query(f"WITH w AS (SELECT doc_id, unnest({TOKENS('text')}) AS word FROM documents) SELECT word, count(*)::BIGINT AS n FROM w WHERE word IN (SELECT unnest({STOP})) GROUP BY word")
def stopword_semijoin(spark, folder):
    words = _docs(spark, folder).select(F.explode(X.word_tokens(F.col("text"))).alias("word"))
    stop = spark.createDataFrame([(w,) for w in X.STOPWORDS_PT], "word string")
    return words.join(F.broadcast(stop), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))  # a fixed list


def sql_reason(clean: str, is_pt: str, source: str = "documents", key: str = "doc_id") -> str:
    """CTE ``r`` with key, source, cleaned text c and reason."""
    return (
        f"c0 AS (SELECT {key}, source, is_pt, {clean} AS c FROM {source}), c1 AS (SELECT *, {WORDS('c')} AS ww, {TOKENS('c')} AS w, {LINES('c')} AS l, {_ALPHA.format('c')} AS a FROM c0), "
        "c2 AS (SELECT *, list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' ')) AS g FROM c1), "
        f"r AS (SELECT {key}, source, c, CASE WHEN NOT (length(c) >= 150 AND len(ww) >= 30) THEN 'length' WHEN coalesce(a, 0) < 0.7 THEN 'alpha_density' WHEN {_REPEATED} > 0.3 THEN 'line_repetition' "
        f"WHEN {_NGRAMS} > 0.2 THEN 'ngram_repetition' WHEN {is_pt} AND len(list_filter(w, lambda x: list_contains({STOP}, x))) < 3 THEN 'pt_stopwords' END AS reason FROM c2)"
    )


REASON = "WITH " + sql_reason(sql_clean("text"), IS_PT.format(flag="is_pt", s="coalesce(source, 'unknown')"))


def reasons(spark, folder):
    """(doc_id, source, text, reason) of the documents, texts cleaned."""
    d = _docs(spark, folder).withColumn("source", F.coalesce("source", F.lit("unknown")))
    return Q.with_reason(d.withColumn("pt", X.resolve_is_pt(F.col("is_pt"), F.col("source"))).select("doc_id", "source", "pt", "text"), F.col("pt"))


@query(REASON + " SELECT doc_id, reason FROM r")
def rejection_reason(spark, folder):
    return reasons(spark, folder).select("doc_id", "reason")


@query(REASON + " SELECT doc_id, md5(c) AS text_md5 FROM r WHERE reason IS NULL")
def filter_document(spark, folder):
    return reasons(spark, folder).filter("reason is null").select("doc_id", F.md5("text").alias("text_md5"))


@query(REASON + " SELECT coalesce(reason, 'kept') AS status, count(*)::BIGINT AS n FROM r GROUP BY 1")
def rejection_counts(spark, folder):
    return reasons(spark, folder).groupBy(F.coalesce("reason", F.lit("kept")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


_SHORT = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS_PT_SHORT) + "]"


def sql_legacy(key: str, text: str, is_pt: str, source: str) -> str:
    """CTE ``legacy`` with key and ``passed``; a character that stands nine times in a row takes the place of a back-reference."""
    ends, punct = f"'^{WS}+|{WS}+$'", r"'^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$'"
    return (
        f"q0 AS (SELECT {key}, regexp_replace(coalesce({text}, ''), {ends}, '', 'g') AS c, {is_pt} AS pt FROM {source}), "
        f"q1 AS (SELECT *, {WORDS('c')} AS w, list_filter(list_transform(regexp_split_to_array(c, '{X.LINE_BREAK}'), lambda x: regexp_replace(x, {ends}, '', 'g')), lambda x: x <> '') AS l FROM q0), "
        f"legacy AS (SELECT {key}, length(c) BETWEEN 150 AND 100000 AND len(list_filter(list_distinct(string_split(c, '')), lambda x: x <> chr(10) AND contains(c, repeat(x, 9)))) = 0 "
        "AND NOT (len(l) >= 6 AND len(list_distinct(l)) / len(l) < 0.6) AND len(w) >= 20 "
        rf"AND length(regexp_replace(c, '[\p{{L}}\p{{N}}]|{WS}', '', 'g')) / greatest(length(c), 1) <= 0.35 "
        f"AND NOT (pt AND len(list_filter(list_transform(w[1:100], lambda x: regexp_replace(lower(x), {punct}, '', 'g')), lambda x: list_contains({_SHORT}, x))) < 3) AS passed FROM q1)"
    )


@query(f"WITH {sql_legacy('doc_id', 'text', 'coalesce(is_pt, false)', 'documents')} SELECT doc_id, passed FROM legacy")
def legacy_quality(spark, folder):
    d = _docs(spark, folder)
    return d.select("doc_id", Q.legacy_quality(F.col("text"), F.coalesce("is_pt", F.lit(False))).alias("passed"))


@query("SELECT vec_id, coalesce(label >= 3, true) AS passed FROM embeddings")
def score_filter(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", Q.score_filter(F.col("label").cast("string")).alias("passed"))


_NORM = f"array_to_string({WORDS('lower(text)')}, ' ')"


@query(f"WITH n AS (SELECT doc_id, row_number() OVER (PARTITION BY sha256({_NORM}) ORDER BY doc_id) AS k FROM documents) SELECT doc_id FROM n WHERE k = 1")
def exact_dedup(spark, folder):
    return D.exact_dedup(_docs(spark, folder).select(F.col("doc_id").alias("seq"), "text")).select(F.col("seq").alias("doc_id"))


@query(f"WITH v AS (SELECT item_id, row_number() OVER (PARTITION BY sha256({_NORM}) ORDER BY item_id) AS k FROM benchmark) SELECT item_id FROM v WHERE k = 1")
def val_admission(spark, folder):
    return D.exact_dedup(table(spark, folder, "benchmark").select(F.col("item_id").alias("seq"), "text")).select(F.col("seq").alias("item_id"))


@query(f"SELECT doc_id FROM documents WHERE sha256({_NORM}) NOT IN (SELECT sha256({_NORM}) FROM benchmark)")
def train_val_disjoint(spark, folder):
    key = F.sha2(X.normalize(F.col("text")), 256)
    return _docs(spark, folder).select("doc_id", key.alias("k")).join(table(spark, folder, "benchmark").select(key.alias("k")), "k", "left_anti").select("doc_id")


def _seq_text(spark, folder):
    return _raw(spark, folder).select("seq", X.text_fallback(F.col("text"), F.col("content"), F.col("raw_content")).alias("text"))


@query()
def minhash_signature(spark, folder):
    s = D.signatures(_seq_text(spark, folder))
    return s.select("seq", F.md5(F.array_join("signature", ",")).alias("signature_md5"))


@query()
def older_minhash(spark, folder):
    return D.older_signatures(_seq_text(spark, folder)).select("seq", F.md5(F.array_join("signature", ",")).alias("signature_md5"))


@query()
def near_dup_pairs(spark, folder):
    return D.similar_pairs(D.signatures(_seq_text(spark, folder)))


@query()
def dedup_greedy(spark, folder):
    return D.greedy_dedup(_seq_text(spark, folder)).select("seq")


@query()
def dedup_ring(spark, folder):
    """What a pass keeps that compares each record with the last 1,000 kept ones only."""
    return D.windowed_dedup(_seq_text(spark, folder), 1000).select("seq")


@query()
def candidate_union(spark, folder):
    return D.candidates(D.distinct_signatures(D.signatures(_seq_text(spark, folder))))


@query()
def val_leak(spark, folder):
    val = table(spark, folder, "benchmark").select(F.col("item_id").alias("seq"), "text")
    return D.held_out_leaks(_docs(spark, folder).select(F.col("doc_id").alias("seq"), "text"), val).select(F.col("seq").alias("doc_id"))


@query()
def train_admission(spark, folder):
    val = table(spark, folder, "benchmark").select(F.col("item_id").alias("seq"), "text")
    return D.train_admission(_docs(spark, folder).select(F.col("doc_id").alias("seq"), "text"), val).select(F.col("seq").alias("doc_id"))


@query()
def signature_similarity(spark, folder):
    """Similarity of all pairs of documents that share a band of their MinHash signatures; equal signatures share all."""
    sigs = materialize(D.signatures(_docs(spark, folder).select(F.col("doc_id").alias("seq"), "text")), "all-signatures")
    pairs = D.similar_pairs(sigs, threshold=0.0)
    group = materialize(sigs.select("seq", F.min("seq").over(W.partitionBy("signature")).alias("first")), "groups")
    left, right = group.select(F.col("seq").alias("m"), F.col("first").alias("a")), group.select(F.col("seq").alias("n"), F.col("first").alias("b"))
    across = pairs.join(left, "a").join(right, "b").select(F.least("m", "n").alias("a"), F.greatest("m", "n").alias("b"), "similarity")
    within = left.join(right, F.col("a") == F.col("b")).filter("m < n").select(F.col("m").alias("a"), F.col("n").alias("b"), F.lit(1.0).alias("similarity"))
    return across.unionByName(within).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("SELECT doc_id, text[1:4] = 'Para' AS starts, round(CASE WHEN length(text) > 10 AND NOT starts_with(text, '!') THEN greatest(s, 0.4) ELSE s END, 6) AS score FROM (SELECT doc_id, text, least(1.0, len(list_filter(['norma', 'theorem', 'safra', 'def '], lambda k: contains(lower(text), k))) / 1.6) AS s FROM documents WHERE text IS NOT NULL)")
def keyword_score(spark, folder):
    keys = F.array(*(F.lit(k) for k in ("norma", "theorem", "safra", "def ")))
    return _docs(spark, folder).filter("text is not null").select("doc_id", F.startswith("text", F.lit("Para")).alias("starts"), F.round(X.keyword_score(F.col("text"), keys), 6).alias("score"))


@query("SELECT doc_id, contains(lower(text), 'norma') OR contains(lower(text), 'theorem') AS matched FROM documents WHERE text IS NOT NULL")
def answer_match(spark, folder):
    return _docs(spark, folder).filter("text is not null").select("doc_id", X.answer_match(F.col("text"), F.array(F.lit(" Norma "), F.lit("theorem"))).alias("matched"))


@query(
    "SELECT doc_id, md5('<|user|>\n' || q || '\n<|assistant|>\n') AS prompt_md5, md5(a || '\n<|endoftext|>\n') AS response_md5 FROM "
    "(SELECT doc_id, substr(text, 1, strpos(text, '\n\n') - 1) AS q, substr(text, strpos(text, '\n\n') + 2) AS a FROM documents WHERE strpos(text, '\n\n') > 0)"
)
def chat_template(spark, folder):
    q, a = X.chat_template(F.col("q"), F.col("a"))
    return _split(spark, folder).select("doc_id", F.md5(q).alias("prompt_md5"), F.md5(a).alias("response_md5"))


def _split(spark, folder):
    parts = F.split("text", "\n\n", 2)
    return _docs(spark, folder).select("doc_id", parts.alias("p")).filter(F.size("p") == 2).select("doc_id", F.col("p")[0].alias("q"), F.col("p")[1].alias("a"))


@query("SELECT doc_id, md5(substr(text, 1, strpos(text, '\n\n') - 1)) AS q_md5, md5(substr(text, strpos(text, '\n\n') + 2)) AS a_md5 FROM documents WHERE strpos(text, '\n\n') > 0")
def split_first_blank(spark, folder):
    return _split(spark, folder).select("doc_id", F.md5("q").alias("q_md5"), F.md5("a").alias("a_md5"))


@query("SELECT doc_id, md5('Problema: ' || q || '\n\nResolução:\n' || a) AS text_md5 FROM (SELECT doc_id, substr(text, 1, strpos(text, '\n\n') - 1) AS q, substr(text, strpos(text, '\n\n') + 2) AS a FROM documents WHERE strpos(text, '\n\n') > 0) WHERE q <> '' AND a <> ''")
def qa_documents(spark, folder):
    return _split(spark, folder).filter("q <> '' and a <> ''").select("doc_id", F.md5(F.concat(F.lit("Problema: "), "q", F.lit("\n\nResolução:\n"), "a")).alias("text_md5"))


@query("SELECT item_id, CASE WHEN suite LIKE '%_pt' THEN 'Pergunta: ' || md5(replace(text, '\nResposta:', '')) ELSE 'Problema: ' || md5(text) END AS prompt FROM benchmark")
def prompt_rewrite(spark, folder):
    b = table(spark, folder, "benchmark")
    return b.select("item_id", F.when(F.endswith("suite", F.lit("_pt")), F.concat(F.lit("Pergunta: "), F.md5(F.replace("text", F.lit("\nResposta:"), F.lit(""))))).otherwise(F.concat(F.lit("Problema: "), F.md5("text"))).alias("prompt"))
