"""Tokenizer, configuration, mixing without end, prefix sums, writers and the commands around them."""

import json
import random

import numpy as np
import pytest

import garimpo
from garimpo.__main__ import main
from garimpo.operators import config, dedup, mixing, packing, tokenizer
from garimpo.plans.pipeline import prepare
from garimpo.plans.prefix import running_offset, running_rank
from garimpo.sources import files, generators, shards
from tests.test_text import GOOD


def small_tokenizer(spark):
    letters = tokenizer.byte_alphabet()
    merges = [(0, "a", "b"), (1, "ab", "c"), (2, "Ġ", "abc"), (3, "Ã", "£")]
    tokens = [*letters, *(a + b for _, a, b in merges), "<|endoftext|>"]
    v = spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, id int")
    return v, spark.createDataFrame(merges, "merge_rank int, left_token string, right_token string"), {t: i for i, t in enumerate(tokens)}


def slow_encode(text, merges, ids):
    import regex

    letters, out = tokenizer.byte_alphabet(), []
    rank = {(a, b): r for r, a, b in merges}
    for piece in regex.findall(tokenizer.PIECES, text):
        s = [letters[x] for x in piece.encode()]
        while found := [(rank[p], i) for i, p in enumerate(zip(s, s[1:])) if p in rank]:
            i = min(found)[1]
            s[i : i + 2] = [s[i] + s[i + 1]]
        out += [ids[t] for t in s]
    return out


def test_tokenizer_equals_stepwise_merging_and_decodes(spark):
    v, m, ids = small_tokenizer(spark)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc ã1.\n") for _ in range(rng.randrange(0, 40))) for _ in range(60)] + [None, "", " abc abcab", "日本 ½"]
    d = spark.createDataFrame(list(enumerate(texts)), "ids_ int, text string")
    got = tokenizer.encode(d, v, m)
    want = [slow_encode(t or "", [tuple(r) for r in m.collect()], ids) for t in texts]
    assert [r["ids"] for r in got.orderBy("ids_").collect()] == want
    back = tokenizer.decode(got, v).orderBy("ids_").collect()
    assert [r["text"] for r in back] == [t or "" for t in texts]


def test_pieces_of_bytes(spark):
    rows = [("<0xC3>", "<0xA9>", "é"), ("<0xE9>", "<0x41>", "éA"), ("<0x41>", "b", "Ab"), ("a", "b", "ab"), ("<0xZZ>", "", "<0xZZ>")]
    d = spark.createDataFrame(rows, "a string, b string, want string")
    got = d.select(tokenizer.merged_text(d.a, d.b).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_overrides_and_stages():
    assert config.overrides(["a=1", "b.c=true", "b.d=[1, 2]", "e=word", "f=null", "g=1e-3"]) == {"a": 1, "b": {"c": True, "d": [1, 2]}, "e": "word", "f": None, "g": 0.001}
    for bad in (["a"], ["=1"], ["a=1", "a.b=2"]):
        with pytest.raises(ValueError):
            config.overrides(bad)
    base = {"x": {"y": 1, "z": 2}, "w": 3}
    assert config.merged(base, {"x": {"y": 5}, "w": {"v": 1}}) == {"x": {"y": 5, "z": 2}, "w": {"v": 1}} and base["x"]["y"] == 1
    assert config.as_int("n", "1e9") == 10**9 and config.as_int("n", 4096.0) == 4096
    for bad in (1.5, True, "inf"):
        with pytest.raises(ValueError):
            config.as_int("n", bad)
    s = config.Stage
    config.check_stages([s(2048, 4, 100), s(4096, 2, 200)], 200)
    for stages, total in (([], 1), ([s(2048, 4, 100), s(4096, 4, 200)], 200), ([s(3000, 4, 100), s(4000, 3, 200)], 200), ([s(8, 1, 200), s(8, 1, 200)], 200), ([s(8, 1, 100)], 200)):
        with pytest.raises(ValueError):
            config.check_stages(stages, total)


def test_cost_of_a_model(spark):
    from pyspark.sql import functions as F

    m = config.Model(width=10, ffn=20, vocab=100, attention_layers=1, heads=2, kv_heads=1, head_size=5)
    weights = 3 * 10 * 10 + 2 * 10 * 5 + 3 * 10 * 20 + 100 * 10
    assert m.weights() == weights
    assert spark.range(1).select(m.flops(F.lit(7))).first()[0] == 6 * weights + 6 * 2 * 5 * 7
    assert spark.range(1).select(m.utilization(F.lit(7), F.lit(1e9), 1.0)).first()[0] == pytest.approx((6 * weights + 420) * 1e9 / 1e12)


def test_running_rank_splits_a_group_over_partitions(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("abc") if rng.random() < 0.9 else None, i) for i in range(3000)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "g string, k int").repartition(8)
    got = running_rank(d, "g", "k", "n").collect()
    seen, want = {}, {}
    for g, k in sorted(rows, key=lambda r: r[1]):
        want[k] = seen[g] = seen.get(g, 0) + 1
    assert {r["k"]: r["n"] for r in got} == want and len(got) == 3000
    assert running_rank(d.limit(0), "g", "k", "n").count() == 0 and running_offset(d.limit(0), "k", d.k).count() == 0


def test_endless_mix_starts_again_and_keeps_the_weights(spark):
    d = spark.createDataFrame([(i, "big" if i < 900 else "small") for i in range(910)], "id int, source string")
    got = mixing.endless(d, "source", "id", {"big": 1.0, "small": 3.0}, 2000, 5).orderBy("step").collect()
    assert [r["step"] for r in got] == list(range(2000)) and 0.7 < sum(r["source"] == "small" for r in got) / 2000 < 0.8
    small = [r["id"] for r in got if r["source"] == "small"]
    assert small == [900 + i % 10 for i in range(len(small))]


def test_blend_falls_back_to_generated_rows(spark):
    got = mixing.blend(spark.range(5).withColumnRenamed("id", "k"), "k", 200, 1).orderBy("step").collect()
    assert [r["k"] for r in got if not r["made"]] == [0, 1, 2, 3, 4] and sum(r["made"] for r in got) == 195


def test_lengths_are_drawn_with_replacement(spark):
    d = spark.createDataFrame([(1, 7), (2, 0), (3, 5), (4, None)], "id int, n int")
    got = [r["n"] for r in mixing.draw_lengths(d, "id", "n", 1000, "s").orderBy("i").collect()]
    assert sum(got) == 1000 and set(got[:-1]) == {5, 7} and got[-1] <= 7
    with pytest.raises(ValueError):
        mixing.draw_lengths(d.filter("n = 0"), "id", "n", 10, "s")


def test_nucleus(spark):
    d = spark.createDataFrame([("a", 50), ("b", 30), ("c", 15), ("d", 5)], "k string, n int")
    assert {r["k"] for r in mixing.nucleus(d, "k", "n", 4, 0.8).collect()} == {"a", "b"}
    assert {r["k"] for r in mixing.nucleus(d, "k", "n", 4, 0.81).collect()} == {"a", "b", "c"}
    assert [tuple(r) for r in mixing.nucleus(d, "k", "n", 1, 0.1).collect()] == [("a", 1.0)]


def test_epochs_cover_every_unit_and_resume(spark):
    grid = packing.unit_grid(spark.createDataFrame([(0, 41), (1, 5), (2, None), (3, 100)], "shard_id int, n_tokens bigint"), 8)
    w = packing.windows_of_epochs(grid, 3, 2, 8, 4, 3)
    rows = w.collect()
    orders = []
    for e in (0, 1):
        own = sorted((r["batch"], r["row"], r["shard_id"], r["start"]) for r in rows if r["epoch"] == e)
        assert len({x[2:] for x in own}) == len(own) == 17 * 2 // 3 * 3
        assert [x[:2] for x in own] == [(i // 3, i % 3) for i in range(len(own))]
        orders.append([x[2:] for x in own])
    assert orders[0] != orders[1]
    left = packing.after_state(w, 0, 5).collect()
    assert {(r["epoch"], r["batch"]) for r in left} == {(0, b) for b in range(5, 11)} | {(1, b) for b in range(11)}
    state = {"shards": [41, 5], "unit_len": 8, "seed": 3}
    packing.check_state(state, dict(state))
    with pytest.raises(ValueError, match="unit_len"):
        packing.check_state(state, {**state, "unit_len": 4})


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_hot_bands_are_split_without_loss(spark, most):
    rng = random.Random(3)
    rows = [(i, 7 if rng.random() < 0.5 else rng.randrange(20)) for i in range(60)]
    d = spark.createDataFrame(rows, "seq int, key int")
    want = {(a, b) for a, x in rows for b, y in rows if x == y}
    got = dedup.band_pairs(d, d, most).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_greedy_keep_of_a_long_chain(spark):
    nodes = spark.range(45).withColumnRenamed("id", "seq")
    edges = spark.createDataFrame([(i, i + 1) for i in range(44)], "a bigint, b bigint")
    assert sorted(r["seq"] for r in dedup.greedy_keep(nodes, edges).collect()) == list(range(0, 45, 2))
    assert dedup.greedy_keep(nodes, edges.limit(0)).count() == 45


def test_ring_forgets():
    r = dedup.Ring(2)
    for x in (1, 2, 3):
        r.add(x)
    assert 1 not in r and 2 in r and 3 in r and len(r.held) == 2


def test_older_signature():
    a, b = dedup.older_signature("A casa de pedra no alto da serra"), dedup.older_signature("a CASA  de pedra no alto da serra\n")
    assert (a == b).all() and len(a) == 64 and a.max() < (1 << 61) - 1
    c = dedup.older_signature("A casa de pedra no alto da serra fria")
    assert 0.4 < (a == c).mean() < 1 and not dedup.older_signature(" ").any() and len(dedup.older_signature("ab")) == 64


def test_pipeline_mixes_tokenizes_and_names_sources(spark, tmp_path):
    v, m, ids = small_tokenizer(spark)
    rows = [(i, f"{GOOD} número {i * 7919} abc" + " abc" * i, "PT-web" if i % 2 else "b") for i in range(8)] + [(9, GOOD, "other")]
    raw = spark.createDataFrame(rows, "seq bigint, text string, _source string")
    p = prepare(raw, 1 << 40, 256, ids["<|endoftext|>"], tokenizer=(v, m), weights={"pt_web": 0.5, "b": 0.5}, capacity=1)
    assert {(r["status"], r["n"]) for r in p.stats().collect()} <= {("accepted", n) for n in range(9)} | {("duplicated", n) for n in range(9)}
    texts = {r["seq"]: r["text"] for r in p.cleaned.collect()}
    back = tokenizer.decode(p.documents.select("seq", "ids"), v).collect()
    assert back and all(r["text"] == texts[r["seq"]] for r in back)
    shards.write_shards(p.tokens(), str(tmp_path / "s"), ids["<|endoftext|>"], 64)
    sides = [json.loads(f.read_text()) for f in sorted((tmp_path / "s").glob("*.json"))]
    assert all(sum(s["sources"].values()) == s["n_tokens"] <= 256 and set(s["sources"]) <= {"pt_web", "b"} for s in sides)
    assert sum(s["n_tokens"] for s in sides) == p.documents.selectExpr("sum(written)").first()[0]
    with pytest.raises(ValueError):
        prepare(raw, 10, 256, weights={"b": -1.0})


def test_prepare_command_on_generated_records(spark, tmp_path, capsys):
    v, m, ids = small_tokenizer(spark)
    from garimpo.operators.vocabulary import contiguous_ids

    files.export_tokenizer(contiguous_ids(v), m, str(tmp_path / "t.json"))
    out = tmp_path / "o"
    assert main(["prepare", "-", str(out), "--mock", "6", "--tokenizer-path", str(tmp_path / "t.json"), "--shard-size", "4096", "--unit-len", "64", "--weight", "code=0.5", "--weight", "pt_web=0.5", "--lsh-capacity", "50"]) == 0
    assert "accepted" in capsys.readouterr().out
    side = json.loads(next(iter(sorted(out.glob("*.json")))).read_text())
    assert side["eos_id"] == ids["<|endoftext|>"] and shards.check_shard(str(next(iter(sorted(out.glob("*.bin")))))) == side["n_tokens"]
    d = spark.createDataFrame([("abc abc ab",)], "text string")
    d.write.parquet(str(tmp_path / "texts"))
    files.export_tokenizer(contiguous_ids(v), m.limit(1), str(tmp_path / "less.json"))
    assert main(["eval-fertility", str(tmp_path / "t.json"), str(tmp_path / "t.json"), str(tmp_path / "texts")]) == 0
    assert main(["eval-fertility", str(tmp_path / "t.json"), str(tmp_path / "less.json"), str(tmp_path / "texts")]) == 1


def test_sample_files(spark, tmp_path):
    files.write_sample(spark.createDataFrame([(0, 5), (3, 2)], "old_id int, new_id int"), spark.createDataFrame([(4, 2), (2, 1)], "length int, n bigint"), str(tmp_path), 5, seed=1)
    assert np.load(tmp_path / "remap.npy").tolist() == [5, 1, 1, 2, 1]
    assert json.loads((tmp_path / "meta.json").read_text()) == {"seed": 1, "n_docs": 3, "n_tokens": 10} and json.loads((tmp_path / "doc_lengths.json").read_text()) == {"2": 1, "4": 2}
    assert files.is_pinned("a" * 40) and not files.is_pinned("main")


def test_generated_records(spark):
    got = generators.mock_records(spark, 3).collect()
    assert len(got) == len({r["seq"] for r in got}) == 12
    assert all((r["text"] is None) == (r["_source"] == "code") and (r["content"] is None) != (r["_source"] == "code") for r in got)


def test_names_of_the_package():
    assert len(garimpo.__all__) >= 18 and all(callable(getattr(garimpo, n)) for n in garimpo.__all__)
    with pytest.raises(AttributeError):
        garimpo.nothing


def test_stopping_a_stream(spark, tmp_path):
    import os
    import signal

    from garimpo.streaming.control import Stopper, counting, progress

    told = []
    q = spark.readStream.format("rate").option("rowsPerSecond", 50).load().writeStream.foreachBatch(counting(10, lambda b, n: told.append(n))).option("checkpointLocation", str(tmp_path)).start()
    s = Stopper(q, (signal.SIGUSR1,))
    while not told:
        q.processAllAvailable()
    os.kill(os.getpid(), signal.SIGUSR1)
    assert s.wait() and not q.isActive and told[0] >= 10 and progress(q)
