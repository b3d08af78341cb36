"""Command line.

``prepare IN OUT``: records in Parquet to token shards. ``compare-runs LOG REFERENCE``: final losses against a run's,
exit code 1 if one fails its gate. ``prune-tokenizer FILE FREQUENCIES OUT --size N``: a vocabulary closed under its merges.
``eval-fertility BASE PRUNED TEXTS``: tokens a word under two tokenizers, exit code 1 if the second needs too many more.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def compare_runs(o: argparse.Namespace) -> int:
    from pyspark.sql import functions as F

    from garimpo.operators import runlog

    spark = SparkSession.builder.getOrCreate()
    final = runlog.final_loss(runlog.first_received(spark.read.parquet(o.log)), o.key)
    reference = final.filter(F.col("run") == o.reference).first()
    if reference is None:
        raise SystemExit(f"no values of {o.reference}")
    rows = final.select("run", "final", runlog.gate(F.lit(reference["final"]), F.col("final"), not o.lossy).alias("g")).orderBy("run").collect()
    for r in rows:
        print(f"| {r['run']} | {r['final']:.6f} | {r['g']['gap']:+.4%} | {'pass' if r['g']['passed'] else 'FAIL'} |")
    return int(not all(r["g"]["passed"] for r in rows))


def prune_tokenizer(o: argparse.Namespace) -> int:
    from garimpo.operators import vocabulary
    from garimpo.sources import files

    spark = SparkSession.builder.getOrCreate()
    vocab, merges = files.tokenizer_file(spark, o.tokenizer)
    chosen = vocabulary.select(vocab, merges, files.token_frequencies(spark, o.frequencies, vocab), vocab.filter(f"id < {o.protect_below}"), o.size)
    kept = vocab.join(chosen, "token", "left_semi")
    files.export_tokenizer(vocabulary.contiguous_ids(kept, o.eos), vocabulary.pruned_merges(merges, chosen), o.output)
    return 0


def run_prepare(o: argparse.Namespace) -> int:
    from garimpo.plans.pipeline import prepare
    from garimpo.sources import files, generators
    from garimpo.sources.shards import write_shards

    spark = SparkSession.builder.getOrCreate()
    tokenizer = files.tokenizer_file(spark, o.tokenizer_path) if o.tokenizer_path else None
    eos = o.eos_id
    if eos is None and tokenizer:
        found = tokenizer[0].filter(f"token = '{o.eos}'").first()
        if found is None:
            raise SystemExit(f"the tokenizer has no token {o.eos}; give --eos-id")
        eos = found["id"]
    eos = 1 if eos is None else eos
    weights = {k: float(v) for k, v in (x.split("=", 1) for x in o.weight)} or None
    raw = generators.mock_records(spark, o.mock) if o.mock else spark.read.parquet(o.input)
    made = prepare(raw, o.max_tokens, o.shard_size, eos, tokenizer=tokenizer, weights=weights, capacity=o.lsh_capacity)
    write_shards(made.tokens(), o.output, eos, o.unit_len)
    made.stats().orderBy("status", "reason").show(truncate=False)
    return 0


def eval_fertility(o: argparse.Namespace) -> int:
    """Exit code 1 if the pruned tokenizer needs too many more tokens a word."""
    from pyspark.sql import functions as F

    from garimpo.functions.text import whitespace_words
    from garimpo.operators import tokenizer, vocabulary
    from garimpo.sources import files

    spark = SparkSession.builder.getOrCreate()
    d = spark.read.parquet(o.texts).select(F.size(whitespace_words(F.col("text"))).alias("w"), "text").filter("w > 0")
    sums = [tokenizer.count_tokens(d, *files.tokenizer_file(spark, p)).agg(F.sum("n_tokens"), F.sum("w")).first() for p in (o.base, o.pruned)]
    if not sums[0][1]:
        raise SystemExit("no words to count")
    base, pruned = (n / w for n, w in sums)
    g = spark.range(1).select(vocabulary.fertility_gate(F.lit(base), F.lit(pruned), o.max_degradation).alias("g")).first()["g"]
    print(f"base {base:.4f}, pruned {pruned:.4f}, ratio {g['ratio']:.4f}: {'pass' if g['passed'] else 'FAIL'}")
    return int(not g["passed"])


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="garimpo")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("prepare")
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("--max-tokens", type=int, default=1 << 40)
    a.add_argument("--shard-size", type=int, default=1 << 28)
    a.add_argument("--unit-len", type=int, default=8192)
    a.add_argument("--eos-id", type=int, help="by default the tokenizer's --eos, else 1")
    a.add_argument("--tokenizer-path", help="JSON file of a byte-level vocabulary; without it, words are hashed")
    a.add_argument("--eos", default="<|endoftext|>", help="the tokenizer's end mark")
    a.add_argument("--weight", action="append", default=[], metavar="SOURCE=W", help="mix the named sources by weight")
    a.add_argument("--lsh-capacity", type=int, help="compare with so many kept records only")
    a.add_argument("--mock", type=int, metavar="N", help="take N generated records of each kind instead of INPUT")
    a = sub.add_parser("eval-fertility")
    a.add_argument("base")
    a.add_argument("pruned")
    a.add_argument("texts")
    a.add_argument("--max-degradation", type=float, default=0.03)
    a = sub.add_parser("compare-runs")
    a.add_argument("log")
    a.add_argument("reference")
    a.add_argument("--key", default="lm_loss")
    a.add_argument("--lossy", action="store_true")
    a = sub.add_parser("prune-tokenizer")
    a.add_argument("tokenizer")
    a.add_argument("frequencies")
    a.add_argument("output")
    a.add_argument("--size", type=int, required=True)
    a.add_argument("--protect-below", type=int, default=261, help="tokens with smaller ids stay")
    a.add_argument("--eos")
    o = p.parse_args(args)
    if o.command == "compare-runs":
        return compare_runs(o)
    if o.command == "prune-tokenizer":
        return prune_tokenizer(o)
    if o.command == "eval-fertility":
        return eval_fertility(o)
    if o.shard_size <= 0 or o.unit_len <= 0 or (o.eos_id or 0) < 0 or o.shard_size % o.unit_len:
        p.error("shard size must be a positive multiple of the unit length, the end mark not negative")
    return run_prepare(o)


if __name__ == "__main__":
    raise SystemExit(main())
