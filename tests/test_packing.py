import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from garimpo.operators import packing as P
from garimpo.plans.prefix import running_offset
from garimpo.sources import shards


def row(spark, ids, column):
    return spark.createDataFrame([(ids,)], "ids array<bigint>").select(column.alias("x")).first()["x"]


def spill(spark, docs, size, eos):
    d = spark.createDataFrame([(i, s, x) for i, (s, x) in enumerate(docs)], "seq bigint, source string, ids array<bigint>")
    return P.shard_parts(P.token_budget(d, "seq", F.size("ids"), 10**9), size)


def test_spill_over_two_shards(spark):
    parts = spill(spark, [("srcA", list(range(10))), ("srcB", list(range(9)))], 16, 100)
    side = {r["shard_id"]: r for r in P.sidecars(parts, "source", 100, 4).collect()}
    assert {k: r["n_tokens"] for k, r in side.items()} == {0: 16, 1: 5}
    assert side[0]["sources"] == {"srcA": 11, "srcB": 5} and side[1]["sources"] == {"srcB": 5}
    t = {(r["shard_id"], r["shard_pos"]): r["tokens"] for r in P.shard_tokens(parts, "ids", 100).collect()}
    assert t == {(0, 0): [*range(10), 100], (0, 11): [0, 1, 2, 3, 4], (1, 0): [5, 6, 7, 8, 100]}


def test_long_and_empty_documents(spark):
    parts = spill(spark, [("a", list(range(29)))], 10, 99)
    assert sorted((r["shard_id"], r["n_part"]) for r in parts.collect()) == [(0, 10), (1, 10), (2, 10)]
    parts = spill(spark, [("a", [])], 8, 5)
    assert [r["tokens"] for r in P.shard_tokens(parts, "ids", 5).collect()] == [[5]]


def test_budget_is_exact(spark):
    d = spark.createDataFrame([(i, [1, 2, 3, 4]) for i in range(10)], "seq bigint, ids array<bigint>")
    got = P.token_budget(d, "seq", F.size("ids"), 13).orderBy("seq").collect()
    assert [(r["seq"], r["off"], r["written"]) for r in got] == [(0, 0, 5), (1, 5, 5), (2, 10, 3)]
    assert P.token_budget(d, "seq", F.size("ids"), 0).count() == 0


def test_running_offset_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(10)) for k in rng.sample(range(10_000), 500)]
    got = {r["k"]: r["off"] for r in running_offset(spark.createDataFrame(rows, "k bigint, v int").repartition(7), "k", F.col("v")).collect()}
    total = 0
    for k, v in sorted(rows):
        assert got[k] == total
        total += v
    assert len(got) == 500


def test_cut_offsets(spark):
    ids = [7 if i in (2, 6, 10, 14) else 1 for i in range(16)]
    assert row(spark, ids, P.cut_offsets(F.col("ids"), 8, 7)) == [0, 3, 7, 8, 11, 15, 16]
    assert row(spark, [], P.cut_offsets(F.col("ids"), 8, 7)) == [0]
    rng = random.Random(2)
    ids = [rng.randrange(5) for _ in range(500)]
    want = sorted({0, 500, *range(0, 500, 25), *(i + 1 for i, x in enumerate(ids) if x == 3)})
    assert row(spark, ids, P.cut_offsets(F.col("ids"), 25, 3)) == want


def test_labels_and_positions(spark):
    ids = [i % 7 for i in range(30)]
    assert row(spark, ids, P.next_labels(F.col("ids"), 6)) == [-100 if x == 6 else ids[i + 1] for i, x in enumerate(ids[:-1])]
    got = row(spark, [9, 9, 1, 2, 9], P.document_positions(F.col("ids"), 9))
    assert [(r["doc"], r["pos"]) for r in got] == [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2)]
    docs = F.array(*(F.lit(x) for x in (0, 0, 0, 1, 2, 2, 2, 2, 2, 2)))
    labels = [10, 11, 12, 13, 14, 15, -100, 17, 18, 19]
    assert row(spark, labels, P.shift_in_document(F.col("ids"), docs, -100)) == [11, 12, -100, -100, 15, -100, 17, 18, 19, -100]


def test_pairs_masks_and_padding(spark):
    ids = F.col("ids")
    assert [tuple(r) for r in row(spark, [5, 6], P.paired_sequence(ids, 1))] == [(5, 6), (6, 1), (1, 65535)]
    assert [tuple(r) for r in row(spark, [5, 1], P.paired_sequence(ids, 1))] == [(5, 1), (1, 65535)]
    assert [tuple(r) for r in row(spark, [], P.paired_sequence(ids, 1))] == [(1, 65535)]
    got = row(spark, [1, 2, 3, 4, 5], P.sft_mask(F.slice(ids, 1, 3), F.slice(ids, 4, 2)))
    assert [tuple(r) for r in got] == [(1, 65535), (2, 65535), (3, 4), (4, 5)]
    assert row(spark, [1, 2], P.pad_or_cut(ids, 4, 0)) == [1, 2, 0, 0] and row(spark, [1, 2, 3], P.pad_or_cut(ids, 2, 0)) == [1, 2]
    assert row(spark, [1, 2, 3], P.causal_conv(ids, [0.5, 0.25])) == [0.5, 1.25, 2.0]
    assert row(spark, [0] * 65, P.chunk_indices(F.size(ids), 32)) == [0, 1, 2]
    assert row(spark, [], P.spread_selection(24, 0.3)) == [0, 3, 6, 10, 13, 17, 20]


def test_epoch_covers_every_window_once(spark):
    assert P.unit_permutation(6, 0, 0, 8).tolist() == [3, 4, 1, 0, 5, 2]
    s = spark.createDataFrame([(0, 16), (1, 40), (2, 21)], "shard_id int, n_tokens bigint")
    grid = P.unit_grid(s, 8)
    assert [tuple(r) for r in grid.orderBy("shard_id").collect()] == [(0, 1, 0), (1, 4, 1), (2, 2, 5)]
    got = P.windows_of_epoch(grid, 0, 0, 8, 4, 3).collect()
    assert len(got) == 12 and len({(r["shard_id"], r["start"]) for r in got}) == 12
    assert {(r["batch"], r["row"]) for r in got} == {(b, k) for b in range(4) for k in range(3)}
    with pytest.raises(ValueError):
        P.windows_of_epoch(grid, 0, 0, 8, 3, 1)


def test_shard_files_round_trip(spark, tmp_path):
    parts = spill(spark, [("a", list(range(10))), ("b", list(range(9)))], 16, 100)
    t = P.shard_tokens(parts, "ids", 100).withColumn("shard_id", F.col("shard_id").cast("int"))
    out = str(tmp_path / "shards")
    shards.write_shards(t, out, 100, 4)
    raw = (tmp_path / "shards" / "shard_00000.bin").read_bytes()
    assert np.frombuffer(raw, "<u4").tolist() == [*range(10), 100, 0, 1, 2, 3, 4]
    side = json.loads((tmp_path / "shards" / "shard_00000.json").read_text())
    assert side == {"n_tokens": 16, "dtype": "uint32", "eos_id": 100, "unit_len": 4, "sha256": hashlib.sha256(raw).hexdigest()}
    assert sorted(p.name for p in (tmp_path / "shards").iterdir()) == ["shard_00000.bin", "shard_00000.json", "shard_00001.bin", "shard_00001.json"]
    got = shards.read_shards(spark, out, block="5").collect()
    assert sorted((r["path"][-9:-4], r["pos"], len(r["tokens"])) for r in got) == [("00000", 0, 5), ("00000", 5, 5), ("00000", 10, 5), ("00000", 15, 1), ("00001", 0, 5)]
    side["n_tokens"] = 15
    (tmp_path / "shards" / "shard_00000.json").write_text(json.dumps(side))
    with pytest.raises(Exception, match="sidecar"):
        shards.read_shards(spark, out).count()
    with pytest.raises(FileNotFoundError):
        shards.resolve([str(tmp_path / "none*.bin")])


def test_token_range_is_checked(spark, tmp_path):
    t = spark.createDataFrame([(0, 0, [1 << 32])], "shard_id int, shard_pos bigint, tokens array<bigint>")
    with pytest.raises(Exception, match="range"):
        shards.write_shards(t, str(tmp_path / "x"), 1, 4)
