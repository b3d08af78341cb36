import random

import numpy as np
import pytest

from garimpo.operators import dedup as D


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq bigint, text string")


def sequential(texts, capacity=10**9, threshold=0.8, num_perm=64, rows=4):
    """A pass over the texts one by one, with a ring of kept signatures."""
    ring, kept = [], []
    for i, t in enumerate(texts):
        tokens = D.shingles(t, 5) if t else []
        if not tokens:
            kept.append(i)
            continue
        s = D.signature(tokens, num_perm)
        b = s.reshape(-1, rows)
        dup = any((b == k.reshape(-1, rows)).all(axis=1).any() and (s == k).mean() >= threshold for k in ring)
        if not dup:
            kept.append(i)
            ring = [*ring, s][-capacity:]
    return kept


def some_texts(seed, n=40):
    rng = random.Random(seed)
    out = [None, "", "só uma", "duas palavras"]
    for _ in range(n):
        w = [f"p{rng.randrange(300)}" for _ in range(rng.randrange(30, 90))]
        out.append(" ".join(w))
        for _ in range(rng.randrange(0, 4)):
            w = list(w)
            w[rng.randrange(len(w))] = "troca"
            out.append(" ".join(w))
    out += out[4:8]
    return out


def test_coefficients_and_empty_signature():
    a, b = D.coefficients(3, 42)
    assert a.tolist()[0] == [6909045637428952501, 8314211556539077903, 4279532810384561225]
    assert (D.signature([]) == 0).all() and D.signature(["x"]).dtype == np.uint64 and len(D.signature(["x"])) == 128
    assert (D.signature(["b", "a", "a"]) == D.signature(["a", "b"])).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_dedup_equals_a_sequential_pass(spark, seed):
    texts = some_texts(seed)
    got = sorted(r["seq"] for r in D.greedy_dedup(docs(spark, texts), num_perm=64).collect())
    assert got == sequential(texts)


def test_window_eviction(spark):
    texts = some_texts(3, 15)
    texts += texts[4:20]
    for capacity in (1, 3, 1000):
        got = sorted(r["seq"] for r in D.windowed_dedup(docs(spark, texts), capacity, num_perm=64).collect())
        assert got == sequential(texts, capacity), capacity


def test_chain_keeps_every_other(spark):
    nodes = spark.createDataFrame([(i,) for i in range(7)], "seq bigint")
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "a bigint, b bigint")
    assert sorted(r["seq"] for r in D.greedy_keep(nodes, edges).collect()) == [0, 2, 4, 6]


@pytest.mark.parametrize("seed", range(3))
def test_frontiers_equal_the_ordered_fold(spark, seed):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(40)}
    want = D.ring_keep([(i, [a for a, b in edges if b == i]) for i in range(25)], 10**9)
    nodes = spark.createDataFrame([(i,) for i in range(25)], "seq bigint")
    got = D.greedy_keep(nodes, spark.createDataFrame(list(edges), "a bigint, b bigint"))
    assert sorted(r["seq"] for r in got.collect()) == want


def test_exact_dedup_keeps_the_first(spark):
    got = D.exact_dedup(docs(spark, ["A  b", "a b", "c", None, "", "C "])).collect()
    assert sorted(r["seq"] for r in got) == [0, 2, 3]


def test_held_out_leaks_and_admission(spark):
    base = " ".join(f"v{i}" for i in range(80))
    near = base.replace("v40", "outro")
    new = " ".join(f"n{i}" for i in range(80))
    train = docs(spark, [base.upper(), near, new, new + " fim", "avulso", None])
    val = docs(spark, [base])
    assert sorted(r["seq"] for r in D.held_out_leaks(train, val).collect()) == [0, 1]
    assert sorted(r["seq"] for r in D.train_admission(train, val).collect()) == [2, 4, 5]


def test_stream_equals_batch(spark, tmp_path):
    from garimpo.streaming.dedup import StreamDedup

    texts = some_texts(5, 12)
    d = docs(spark, texts)
    for k in range(3):
        d.filter(f"seq >= {k * 15} and seq < {(k + 1) * 15 if k < 2 else 10**6}").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    s = StreamDedup(str(tmp_path / "out"), num_perm=64)
    for k in range(3):
        stream = spark.readStream.schema("seq bigint, text string").parquet(str(tmp_path / "in" / f"part={k}"))
        if k == 0:
            s.start(stream, str(tmp_path / "state")).awaitTermination()
        else:
            s.process(spark.read.parquet(str(tmp_path / "in" / f"part={k}")), k)
    s.process(spark.read.parquet(str(tmp_path / "in" / "part=2")), 2)  # repeated after a failure
    assert sorted(r["seq"] for r in spark.read.parquet(s.out).collect()) == sequential(texts)
