"""Registered queries do the whole job: nothing behind a prefix or outside a fixed subset of the rows is left out."""

import hashlib
import random

import duckdb
import pytest

from garimpo.operators import dedup
from garimpo.operators.mixing import drawn_order
from garimpo.plans import registry

registry.load()


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def run(spark, folder, name):
    return registry.QUERIES[name](spark, str(folder))


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def word_id(w):
    return int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 50_000 + 2


@pytest.fixture(scope="module")
def long_documents(spark, tmp_path_factory):
    """More than 50,000 words, with an empty text among them."""
    rng, folder = random.Random(5), tmp_path_factory.mktemp("long")
    docs = [(i, " ".join(f"p{rng.randrange(999)}" for _ in range(n)), s) for i, (n, s) in enumerate([(20_000, "a"), (25_000, None), (0, "a"), (30_000, "b"), (5_000, "a")])]
    write(spark, folder, "documents", docs, "doc_id bigint, text string, source string")
    return folder, docs


@pytest.mark.parametrize("name", ["shard_spill", "shard_tokens", "shard_sidecar", "tokens_by_shard_source"])
def test_shards_hold_all_documents(spark, long_documents, name):
    folder, _ = long_documents
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    res = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert rows_of(run(spark, folder, name)) == sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in res.fetchall())


def test_round_trip_holds_all_documents(spark, long_documents):
    folder, docs = long_documents
    stream = [t for _, text, _ in docs for t in [*map(word_id, text.split()), 1]]
    want = [(sum(stream[i : i + 4096]), len(stream[i : i + 4096]), i // 4096) for i in range(0, len(stream), 4096)]
    assert rows_of(run(spark, folder, "shard_round_trip").select("id_sum", "n_tokens", "shard_id")) == sorted(want)


@pytest.fixture(scope="module")
def many_records(spark, tmp_path_factory):
    """220,000 words in texts that pass all filters and share nothing."""
    rng, folder = random.Random(6), tmp_path_factory.mktemp("many")
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, " ".join("".join(rng.choices(letters, k=6)) for _ in range(20_000)), None, None, f"code_{i % 2}", None, False) for i in range(11)]
    write(spark, folder, "raw_docs", rows, "seq bigint, text string, content string, raw_content string, _source string, source string, is_pt boolean")
    return folder


def test_pipeline_has_no_cap(spark, many_records):
    assert [(r["status"], r["reason"], r["n"]) for r in run(spark, many_records, "pipeline_stats").collect()] == [("accepted", None, 11)]


def test_pipeline_shards_hold_all_tokens(spark, many_records):
    got = run(spark, many_records, "pipeline_shards").orderBy("shard_id").collect()
    n = 11 * 20_001
    assert [r["n_tokens"] for r in got] == [8192] * (n // 8192) + [n % 8192]
    by = {}
    for r in got:
        for k, v in (x.split("=") for x in r["sources"].split(";")):
            by[k] = by.get(k, 0) + int(v)
    assert by == {"code_0": 6 * 20_001, "code_1": 5 * 20_001}


GOOD = " ".join("A casa de pedra fica no alto da serra e a vista para o vale é bonita em dias de sol".split()[i % 20] + str(i // 20 or "") for i in range(60))
ENGLISH = " ".join(f"every{i} house{i} stands{i}" for i in range(30))


def test_pt_quality_stream_judges_whole_texts(spark, tmp_path):
    short = GOOD[:200]  # good texts of 150 to 500 characters count, flooded, foreign and repeated ones don't
    bad = [GOOD + " " + "!" * 9, ENGLISH * 2, "\n".join(["uma linha de que não se para"] * 30)]
    rows = [(0, short, None, None), (1, "", None, GOOD), (2, None, GOOD, None), (3, None, None, None), *((4 + i, t, None, None) for i, t in enumerate(bad))]
    write(spark, tmp_path, "raw_docs", rows, "seq bigint, text string, content string, raw_content string")
    assert rows_of(run(spark, tmp_path, "pt_quality_stream")) == [(0,), (1,), (2,)]


def test_edu_quality_stream_reads_the_texts(spark, tmp_path):
    write(spark, tmp_path, "documents", [(0, ENGLISH), (1, ENGLISH), (2, ENGLISH + "#" * 9), (3, ENGLISH), (4, "short")], "doc_id bigint, text string")
    write(spark, tmp_path, "embeddings", [(0, [0.0], 3), (1, [0.0], 2), (2, [0.0], 5)], "vec_id bigint, embedding array<float>, label int")
    assert rows_of(run(spark, tmp_path, "edu_quality_stream")) == [(0,), (3,)]


def test_prompt_response_pairs_cover_all_conversations(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, rng.randrange(40), rng.randrange(10), f"t{i % 5}") for i in range(300)]
    write(spark, tmp_path, "events", rows, "event_id bigint, ts bigint, user_id bigint, event_type string")
    want = []
    for u in range(10):
        own = sorted((ts, e, kind) for e, ts, user, kind in rows if user == u)
        want += [(a[2], a[1], b[2], b[1], k + 1, u) for k, (a, b) in enumerate(zip(own, own[1:]))]
    assert rows_of(run(spark, tmp_path, "prompt_response_pairs")) == sorted(want)


def test_signature_similarity_of_all_candidates(spark, tmp_path):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(5000)}" for _ in range(n)] for n in (120, 80, 60, 9)]
    texts = {}
    for i in range(24):
        w = list(base[i % 4])
        for _ in range(i // 8):  # copies, then texts with words changed behind the 16th or at the end
            w[rng.randrange(min(16, len(w) - 1), len(w))] = f"x{rng.randrange(5000)}"
        texts[i * 3] = " ".join(w)
    texts[100], texts[101] = "", None
    write(spark, tmp_path, "documents", list(texts.items()), "doc_id bigint, text string")
    sig = {k: dedup.signature(dedup.shingles(t, 5)) for k, t in texts.items() if t}
    want = []
    for a in sig:
        for b in sig:
            if a < b and any((sig[a][i : i + 4] == sig[b][i : i + 4]).all() for i in range(0, 128, 4)):
                want.append((a, b, int((sig[a] == sig[b]).sum())))
    assert any(s < 128 for *_, s in want) and any(s == 128 for *_, s in want)
    assert [(a, b, round(s * 128)) for a, b, s in rows_of(run(spark, tmp_path, "signature_similarity"))] == sorted(want)


SPELT = ["pt_web", "PT_WEB", "pt-web", " pt_web", "code ", "Code", "math_en", "Math_En", "pt_legal", None, "other"]
WEIGHTS = {"pt_web": 0.5, "code": 0.2, "math_en": 0.1, "pt_legal": 0.15, "pt_news": 0.05}


@pytest.fixture(scope="module")
def mixable(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("mix")
    write(spark, folder, "documents", [(i, SPELT[i % len(SPELT)]) for i in range(110)], "doc_id bigint, source string")
    write(spark, folder, "mix_targets", list(WEIGHTS.items()), "source string, weight double")
    names = ["pt_web"] * 4 + ["code"] * 2 + ["math_en"] * 2 + ["pt_legal", None, None]
    return folder, {i: names[i % len(SPELT)] for i in range(110) if names[i % len(SPELT)]}


def test_weighted_mix_takes_all_sources_in_any_spelling(spark, mixable):
    folder, source = mixable
    n, want = dict.fromkeys(WEIGHTS, 0), []
    for i, s in source.items():
        n[s] += 1
        want.append((i, n[s] / WEIGHTS[s], s))
    got = rows_of(run(spark, folder, "weighted_mix"))
    assert [(i, s) for i, _, s in got] == [(i, s) for i, _, s in want]
    assert [p for _, p, _ in got] == pytest.approx([p for _, p, _ in want], abs=1e-6)


def test_weighted_draws_take_all_sources_in_any_spelling(spark, mixable):
    folder, source = mixable
    own = {s: [i for i, x in source.items() if x == s] for s in sorted(set(source.values()))}
    want = [(own[s][k], d, s) for d, s, k in drawn_order({s: len(x) for s, x in own.items()}, WEIGHTS)]
    assert rows_of(run(spark, folder, "weighted_draws")) == sorted(want)


def chosen(vocab, merges, size=1000):
    """Brute force of the selection: protected ids below 261, then by falling frequency, then the cheapest, closed under the merges."""
    last = {x + y: (x, y) for _, x, y in sorted(merges)}

    def need(t, seen):
        if t not in seen:
            seen.add(t)
            for p in last.get(t, ()):
                need(p, seen)
        return seen

    closed = {t: need(t, set()) for t, _ in vocab}
    freq = {t: int(hashlib.md5(t.encode()).hexdigest()[:6], 16) % 1000 for t, _ in vocab}
    order, out = sorted(vocab, key=lambda x: x[1]), set()
    for t, i in order:
        if i < 261:
            out |= closed[t]
    for t, _ in sorted((x for x in order if freq[x[0]] > 0), key=lambda x: -freq[x[0]]):
        if len(out | closed[t]) <= size:
            out |= closed[t]
    while len(out) < size:
        out |= min((len(closed[t] - out), k, closed[t]) for k, (t, _) in enumerate(order) if t not in out and len(out | closed[t]) <= size)[2]
    return out


def test_vocabulary_queries_take_the_selected_vocabulary(spark, data):
    vocab = [(r["token"], r["id"]) for r in registry.table(spark, data, "vocab").collect()]
    merges = [(r["merge_rank"], r["left_token"], r["right_token"]) for r in registry.table(spark, data, "merges").collect()]
    s = chosen(vocab, merges)
    assert len(s) == 1000
    new = {t: k for k, (t, _) in enumerate(sorted((x for x in vocab if x[0] in s), key=lambda x: x[1]))}
    assert rows_of(run(spark, data, "contiguous_ids")) == sorted((new[t], i, t) for t, i in vocab if t in s)
    assert rows_of(run(spark, data, "vocab_remap")) == sorted((new.get(t, -1), i) for t, i in vocab)
    assert rows_of(run(spark, data, "pruned_merges")) == sorted((x, k, y) for k, x, y in merges if {x, y, x + y} <= s)
    assert rows_of(run(spark, data, "protected_vocab")) == sorted({(x,) for _, x, _ in merges if x in s})
