import importlib.util

import pytest

from garimpo.plans import registry
from garimpo.plans.pipeline import prepare
from tests.test_text import GOOD

registry.load()


def records(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq bigint, text string, content string, raw_content string, _source string, is_pt boolean")


def test_statuses_add_up(spark):
    code = " ".join(f"valor{i} funcao{i} retorno{i}" for i in range(30))
    rows = [(GOOD, None, None, "pt_web", None)] * 10 + [(None, "", None, "x", None), ("curto", None, None, "x", None), (None, code, None, "code", None), ("", None, code.replace("valor3", "outro"), "python_scripts", None)]
    p = prepare(records(spark, rows), 10_000, 64)
    got = {(r["status"], r["reason"]): r["n"] for r in p.stats().collect()}
    assert got == {("accepted", None): 2, ("duplicated", None): 10, ("filtered", "length"): 2}
    assert sum(r["n_tokens"] for r in p.sidecars(8).collect()) == p.documents.selectExpr("sum(written)").first()[0]
    assert all(len(r["tokens"]) <= 64 for r in p.tokens().collect())


def test_budget_stops_the_rest(spark):
    p = prepare(records(spark, [(GOOD, None, None, "a", None), (GOOD.upper() + " fim mesmo assim de tudo que há", None, None, "a", None)]), 20, 64)
    assert {r["status"] for r in p.status.collect()} <= {"accepted", "over_budget", "duplicated"}
    assert p.documents.selectExpr("sum(written)").first()[0] == 20


QUICK = ["rejection_counts", "exact_dedup", "shard_sidecar", "cu_seqlens", "bpe_ancestors", "freq_remap", "final_loss", "interval_union", "weighted_mix", "event_sessions", "clean_boilerplate", "loss_spikes"]


def norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", QUICK)
def test_queries_equal_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "raw_docs", "benchmark", "mix_targets", "vocab", "merges", "train_log", "shard_index", "events", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    df = registry.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    res = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=str)
    assert sorted(names) == cols and got == want


def test_entry_without_the_llm_package():
    spec = importlib.util.find_spec("__spark_entry__")
    source = open(spec.origin).read()
    assert "except ImportError" in source
    import os
    import re

    root = os.path.dirname(spec.origin)
    for folder, _, files in os.walk(os.path.join(root, "garimpo")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"garimpo\.llm|from garimpo import llm", open(os.path.join(folder, f)).read()), f
