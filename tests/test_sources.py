import json

import pytest

from garimpo.__main__ import main
from garimpo.sources import pairs

ROWS = [(k, [k, 1, 2], [1, 2, 65535], [k, 3, 4], [3, 4, 65535], -1.5, -2.75) for k in range(7)]


def test_preference_pairs_round_trip(spark, tmp_path):
    d = spark.createDataFrame(ROWS, pairs.SCHEMA).repartition(3)
    path = str(tmp_path / "p.bin")
    pairs.write_pairs(d, path, 3, 50_000)
    assert pairs.read_header(path) == (3, 7, 50_000)
    got = pairs.read_pairs(spark, path, block="2")
    assert sorted(map(tuple, got.collect())) == ROWS
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError, match="size"):
        pairs.read_header(path)
    with pytest.raises(ValueError, match="16 bits"):
        pairs.write_pairs(spark.createDataFrame([(0, [70_000], [1], [1], [1], 0.0, 0.0)], pairs.SCHEMA), path, 1, 9)


def test_commands(spark, tmp_path, capsys):
    rows = [(r, i, v, i) for r, v in (("ref", 2.0), ("same", 2.004), ("worse", 2.5)) for i in range(20)]
    d = spark.createDataFrame(rows, "run string, line bigint, lm_loss double, received_at int")
    d.write.parquet(str(tmp_path / "log"))
    d.filter("run <> 'worse'").write.parquet(str(tmp_path / "good"))
    assert main(["compare-runs", str(tmp_path / "log"), "ref"]) == 1 and "FAIL" in capsys.readouterr().out
    assert main(["compare-runs", str(tmp_path / "good"), "ref"]) == 0
    (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4, "abc": 5}, "merges": ["a b", "b c", "ab c"]}}))
    (tmp_path / "f.json").write_text(json.dumps({"abc": 9, "bc": 5}))
    assert main(["prune-tokenizer", str(tmp_path / "t.json"), str(tmp_path / "f.json"), str(tmp_path / "o.json"), "--size", "5", "--protect-below", "3", "--eos", "a"]) == 0
    out = json.loads((tmp_path / "o.json").read_text())["model"]
    assert out["vocab"] == {"b": 0, "c": 1, "ab": 2, "abc": 3, "a": 4} and out["merges"] == [["a", "b"], ["ab", "c"]]
    with pytest.raises(SystemExit):
        main(["prepare", "in", "out", "--shard-size", "10", "--unit-len", "3"])
