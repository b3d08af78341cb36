"""Scans of texts, JSON lines and vocabularies, and small sinks."""

from __future__ import annotations

import json
import os
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions.text import strip


def jsonl_field(spark: SparkSession, paths: list[str] | str, field: str = "text") -> DataFrame:
    """(file, text): one field of each JSON line; blank lines are skipped, a line without the field is an error.

    Compressed files can't be split: one task a file.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file")).filter(strip(F.col("value")) != "")
    got = F.from_json("value", f"`{field}` string", {"mode": "FAILFAST"})[field]
    return lines.select("file", F.when(got.isNull(), F.raise_error(F.concat(F.lit(f"no {field} in "), "file"))).otherwise(got).alias("text"))


def metric_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON metric lines under a fixed schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def head_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(line): the first ``n`` lines of a small text file that are not blank, stripped."""
    d = spark.read.text(path).withColumn("k", F.monotonically_increasing_id()).select("k", strip(F.col("value")).alias("line")).filter("line <> ''")
    return d.orderBy("k").limit(n).select("line")


def is_pinned(revision: str) -> bool:
    """Whether a revision is a full hexadecimal commit hash."""
    return bool(re.fullmatch(r"[0-9a-f]{40}", revision))


def pinned(revision: Column) -> Column:
    """``is_pinned`` of a column; false for null."""
    return F.coalesce(revision.rlike("^[0-9a-f]{40}$"), F.lit(False))


def write_sample(remap: DataFrame, lengths: DataFrame, folder: str, size: int, **meta) -> None:
    """Beside a sample's shards: ``remap.npy`` (new id by old id, ``size`` entries), ``doc_lengths.json`` and ``meta.json``.

    ``remap(old_id, new_id)`` has a vocabulary's size; ``lengths(length, n)`` one row for each length that occurs.
    """
    os.makedirs(folder, exist_ok=True)
    table = np.full(size, 1, np.uint32)
    for r in remap.collect():
        table[r["old_id"]] = r["new_id"]
    np.save(os.path.join(folder, "remap.npy"), table)
    counts = {int(r["length"]): int(r["n"]) for r in lengths.orderBy("length").collect()}
    with open(os.path.join(folder, "doc_lengths.json"), "w") as f:
        json.dump(counts, f)
    with open(os.path.join(folder, "meta.json"), "w") as f:
        json.dump({**meta, "n_docs": sum(counts.values()), "n_tokens": sum(k * n for k, n in counts.items())}, f)


def token_frequencies(spark: SparkSession, path: str, vocab: DataFrame) -> DataFrame:
    """(token, freq) from JSON (by token, by id as digits, or a list by id) or from ``.npy`` (by id)."""
    if path.endswith(".npy"):
        rows = list(enumerate(np.load(path).tolist()))
    elif path.endswith(".json"):
        with open(path) as f:
            got = json.load(f)
        rows = list(got.items()) if isinstance(got, dict) else list(enumerate(got))
    else:
        raise ValueError(f"{path}: unknown kind of file")
    d = spark.createDataFrame([(str(k), int(v)) for k, v in rows], "key string, freq bigint")
    literal = d.join(vocab.select(F.col("token").alias("key")), "key", "left_semi").select(F.col("key").alias("token"), "freq")
    by_id = d.join(vocab.select(F.col("token").alias("key")), "key", "left_anti").filter(F.col("key").rlike("^[0-9]+$")).join(vocab.select("token", F.col("id").cast("string").alias("key")), "key").select("token", "freq")
    return literal.unionByName(by_id).groupBy("token").agg(F.max("freq").alias("freq"))


def tokenizer_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vocab, merges) of a tokenizer's JSON file; added tokens count where the vocabulary lacks them."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    model = t.get("model", t)
    vocab = dict(model["vocab"])
    for a in t.get("added_tokens", []):
        vocab.setdefault(a["content"], a["id"])
    pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    v = spark.createDataFrame(list(vocab.items()), "token string, id int")
    return v, spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "merge_rank int, left_token string, right_token string")


def export_tokenizer(vocab: DataFrame, merges: DataFrame, path: str) -> None:
    """Write ``vocab(token, new_id)`` and ``merges`` (of fixed size) as a tokenizer's JSON file."""
    v = {r["token"]: r["new_id"] for r in vocab.orderBy("new_id").collect()}
    m = [[r["left_token"], r["right_token"]] for r in merges.orderBy("merge_rank").collect()]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"model": {"type": "BPE", "vocab": v, "merges": m}}, f, ensure_ascii=False)
