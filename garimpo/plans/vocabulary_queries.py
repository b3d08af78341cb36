"""Queries on the vocabulary and its merges."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from garimpo.functions.text import whitespace_words
from garimpo.operators import vocabulary as V
from garimpo.plans.materialize import materialize
from garimpo.plans.packing_queries import DOC, EOS, FREQ, docs, frequencies
from garimpo.plans.registry import query, table


def _m(spark, folder):
    return table(spark, folder, "merges")


def _v(spark, folder):
    return table(spark, folder, "vocab")


EDGES = "e0 AS (SELECT left_token || right_token AS token, left_token, right_token, row_number() OVER (PARTITION BY left_token || right_token ORDER BY merge_rank DESC) AS k FROM merges), e AS (SELECT token, left_token AS parent FROM e0 WHERE k = 1 UNION SELECT token, right_token FROM e0 WHERE k = 1)"
CLOSURE = f"WITH RECURSIVE {EDGES}, a AS (SELECT token, parent AS ancestor FROM e UNION SELECT a.token, e.parent FROM a JOIN e ON e.token = a.ancestor)"
FREQUENCY = "('0x' || substr(md5(token), 1, 6))::BIGINT % 1000"


@query(f"WITH {EDGES} SELECT token, parent FROM e")
def bpe_edges(spark, folder):
    return V.edges(_m(spark, folder))


@query(CLOSURE + " SELECT token, ancestor FROM a")
def bpe_ancestors(spark, folder):
    return V.ancestors(V.edges(_m(spark, folder)))


@query("WITH r AS (SELECT left_token || right_token AS token, left_token, right_token FROM merges) SELECT count(*) = 0 AS closed FROM r WHERE token IN (SELECT token FROM vocab) AND (left_token NOT IN (SELECT token FROM vocab) OR right_token NOT IN (SELECT token FROM vocab))")
def merge_closed(spark, folder):
    return V.unclosed(_v(spark, folder), _m(spark, folder)).agg((F.count(F.lit(1)) == 0).alias("closed"))


def _frequencies(spark, folder):
    return _v(spark, folder).select("token", (F.conv(F.substring(F.md5("token"), 1, 6), 16, 10).cast("bigint") % 1000).alias("freq"))


def _protected(spark, folder):
    return _v(spark, folder).filter("id < 261")


@query()
def select_vocab(spark, folder):
    return V.select(_v(spark, folder), _m(spark, folder), _frequencies(spark, folder), _protected(spark, folder), 1000)


def selected(spark, folder):
    """(token, id) of the selected vocabulary; a written table."""
    return materialize(_v(spark, folder).join(select_vocab(spark, folder), "token", "left_semi"), "selected")


@query()
def pruned_merges(spark, folder):
    return V.pruned_merges(_m(spark, folder), selected(spark, folder))


@query("SELECT token, id FROM vocab WHERE length(token) = 1 AND token NOT IN (SELECT left_token || right_token FROM merges)")
def byte_protected(spark, folder):
    return _v(spark, folder).filter("length(token) = 1").join(_m(spark, folder).select(F.concat("left_token", "right_token").alias("token")), "token", "left_anti").select("token", "id")


@query()
def protected_vocab(spark, folder):
    return selected(spark, folder).select("token").intersect(_m(spark, folder).select("left_token"))


@query()
def contiguous_ids(spark, folder):
    return V.contiguous_ids(selected(spark, folder))


@query()
def vocab_remap(spark, folder):
    return V.remap(_v(spark, folder), V.contiguous_ids(selected(spark, folder)))


@query(f"SELECT token, {FREQUENCY} AS freq, row_number() OVER (ORDER BY {FREQUENCY} DESC, id) AS place FROM vocab")
def candidate_order(spark, folder):
    d = _v(spark, folder).join(_frequencies(spark, folder), "token")
    return d.select("token", "freq", F.row_number().over(W.orderBy(F.desc("freq"), "id")).alias("place"))


RANKED = FREQ + ", k AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS r FROM c WHERE token <> 1), m AS (SELECT token AS old_id, CASE WHEN r <= 998 THEN r + 1 ELSE 1 END AS new_id FROM k)"


def _counts(ids):
    return ids.select(F.explode("ids").alias("old_id")).groupBy("old_id").agg(F.count(F.lit(1)).alias("n"))


def _remap(spark, folder):
    return V.frequency_remap(frequencies(spark, folder).withColumnRenamed("token", "old_id"), EOS, 1000)


@query(RANKED + " SELECT old_id, new_id FROM m")
def freq_remap(spark, folder):
    return _remap(spark, folder)


@query(RANKED + ", x AS (SELECT doc_id, unnest(ids) AS token FROM t) SELECT doc_id, sum(new_id)::BIGINT AS id_sum, count(*)::BIGINT AS n FROM x JOIN m ON m.old_id = x.token GROUP BY doc_id")
def token_remap(spark, folder):
    ids = materialize(docs(spark, folder).select("doc_id", "ids"), "ids")  # read twice
    t = ids.select("doc_id", F.explode("ids").alias("old_id")).groupBy("doc_id", "old_id").agg(F.count(F.lit(1)).alias("k"))  # pre-aggregated before the join
    return t.join(V.frequency_remap(_counts(ids), EOS, 1000), "old_id").groupBy("doc_id").agg(F.sum(F.col("new_id") * F.col("k")).alias("id_sum"), F.sum("k").alias("n"))


@query(RANKED + " SELECT round(sum(CASE WHEN new_id = 1 THEN n ELSE 0 END) / sum(n), 6) AS unk_rate FROM m JOIN c ON c.token = m.old_id")
def unk_rate(spark, folder):
    f = materialize(frequencies(spark, folder).withColumnRenamed("token", "old_id"), "frequencies")
    m = V.frequency_remap(f, EOS, 1000).join(f, "old_id")
    return m.agg(F.round(F.sum(F.when(F.col("new_id") == 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("unk_rate"))
