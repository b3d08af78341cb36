import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from garimpo.operators import vocabulary as V
from garimpo.sources import files


def merges(spark, pairs):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "merge_rank int, left_token string, right_token string")


def vocab(spark, tokens):
    return spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, id int")


def test_ancestors_and_closure(spark):
    m = merges(spark, [("a", "b"), ("c", "d"), ("ab", "cd")])
    got = V.ancestors(V.edges(m)).filter("token = 'abcd'").collect()
    assert {r["ancestor"] for r in got} == {"ab", "cd", "a", "b", "c", "d"}
    assert V.unclosed(vocab(spark, ["a", "b", "c", "d", "ab", "cd", "abcd"]), m).count() == 0
    assert V.unclosed(vocab(spark, ["a", "b", "c", "ab", "cd", "abcd"]), m).count() == 1


def freq(spark, f):
    return spark.createDataFrame(list(f.items()) or [("none", 0)], "token string, freq bigint")


def test_greedy_selection(spark):
    tokens = ["a", "b", "c", "d", "e", "ab", "abc", "de"]
    m = merges(spark, [("a", "b"), ("ab", "c"), ("d", "e")])
    must = vocab(spark, tokens[:5])
    got = {r["token"] for r in V.select(vocab(spark, tokens), m, freq(spark, {"abc": 100, "de": 50, "ab": 10}), must, 7).collect()}
    assert got == {*tokens[:5], "ab", "abc"}
    kept = V.pruned_merges(m, spark.createDataFrame([(t,) for t in got], "token string"))
    assert [(r["left_token"], r["right_token"]) for r in kept.orderBy("merge_rank").collect()] == [("a", "b"), ("ab", "c")]
    with pytest.raises(Exception, match="less than"):
        V.select(vocab(spark, tokens), m, freq(spark, {}), must, 3).collect()
    with pytest.raises(Exception, match="more than"):
        V.select(vocab(spark, tokens), m, freq(spark, {}), must, 30).collect()


def test_residual_takes_the_cheapest(spark):
    tokens = ["p", "q", "xx", "x", "y"]
    m = merges(spark, [("x", "x")])
    got = {r["token"] for r in V.select(vocab(spark, tokens), m, freq(spark, {"y": 10}), vocab(spark, ["p", "q"]), 4).collect()}
    assert got == {"p", "q", "y", "x"}


def test_remap(spark):
    old = vocab(spark, ["a", "b", "c", "d", "e"])
    new = V.contiguous_ids(old.filter("token <> 'd'"))
    assert [r["new_id"] for r in V.remap(old, new).orderBy("old_id").collect()] == [0, 1, 2, -1, 3]
    last = V.contiguous_ids(old, "a").orderBy("new_id").collect()
    assert [r["token"] for r in last] == ["b", "c", "d", "e", "a"]


@pytest.mark.parametrize("counts,want", [([5, 0, 9, 9, 1, 7], [1, 1, 2, 0, 1, 3]), ([4, 4, 4, 1], [2, 3, 1, 0])])
def test_frequency_remap(spark, counts, want):
    d = spark.createDataFrame(list(enumerate(counts)), "old_id bigint, n bigint")
    assert [r["new_id"] for r in V.frequency_remap(d, 3, 4).orderBy("old_id").collect()] == want


def test_fertility_gate(spark):
    d = spark.createDataFrame([(100, 103)], "a int, b int").select(V.fertility_gate(F.col("a"), F.col("b")).alias("g"), V.fertility_gate(F.col("a"), F.col("b") + 1).alias("h")).first()
    assert d["g"]["passed"] and not d["h"]["passed"]


def test_vocabulary_files(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}, "added_tokens": [{"content": "<s>", "id": 3}, {"content": "a", "id": 9}]}))
    v, m = files.tokenizer_file(spark, str(path))
    assert {(r["token"], r["id"]) for r in v.collect()} == {("a", 0), ("b", 1), ("ab", 2), ("<s>", 3)} and m.count() == 1
    files.export_tokenizer(V.contiguous_ids(v), m, str(tmp_path / "o.json"))
    v2, m2 = files.tokenizer_file(spark, str(tmp_path / "o.json"))
    assert v2.count() == 4 and m2.collect() == m.collect()
    (tmp_path / "f.json").write_text(json.dumps({"a": 5, "1": 7}))
    assert {tuple(r) for r in files.token_frequencies(spark, str(tmp_path / "f.json"), v).collect()} == {("a", 5), ("b", 7)}
    np.save(tmp_path / "f.npy", np.array([3, 4]))
    assert {tuple(r) for r in files.token_frequencies(spark, str(tmp_path / "f.npy"), v).collect()} == {("a", 3), ("b", 4)}
    with pytest.raises(ValueError):
        files.token_frequencies(spark, "f.pt", v)


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "um"}\n\n{"text": "dois", "x": 1}\n')
    assert sorted(r["text"] for r in files.jsonl_field(spark, str(tmp_path / "a.jsonl")).collect()) == ["dois", "um"]
    (tmp_path / "b.jsonl").write_text('{"outro": "um"}\n')
    with pytest.raises(Exception, match="no text"):
        files.jsonl_field(spark, str(tmp_path / "b.jsonl")).collect()
    (tmp_path / "c.txt").write_text("\n um \n\ndois\ntres\n")
    assert [r["line"] for r in files.head_lines(spark, str(tmp_path / "c.txt"), 2).collect()] == ["um", "dois"]
    assert files.is_pinned("a" * 40) and not files.is_pinned("main")
