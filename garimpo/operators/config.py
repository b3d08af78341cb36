"""Configuration of training runs: overrides, stages, and the cost of a model in operations for each token."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _value(text: str):
    """A value as written on a command line: JSON where it is that, a plain word otherwise."""
    plain = text.strip()
    if plain.lower() in ("true", "false", "null", ""):
        return {"true": True, "false": False}.get(plain.lower())
    try:
        return json.loads(plain)
    except ValueError:
        return plain


def overrides(pairs: list[str]) -> dict:
    """``["a=1", "b.c=true"]`` as a nested dictionary; dots open a level."""
    out: dict = {}
    for pair in pairs:
        path, found, text = pair.partition("=")
        if not path or not found:
            raise ValueError(f"{pair!r} is not KEY=VALUE")
        *levels, last = path.split(".")
        at = out
        for level in levels:
            at = at.setdefault(level, {})
            if not isinstance(at, dict):
                raise ValueError(f"{pair!r}: {level!r} already has a plain value")
        at[last] = _value(text)
    return out


def merged(base: dict, more: dict) -> dict:
    """``base`` with the values of ``more``, level by level; neither is changed."""
    out = dict(base)
    for k, v in more.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def as_int(name: str, value) -> int:
    """A whole number, also written as ``1e9`` or ``"4_096"``."""
    number = float(str(value).replace("_", "")) if not isinstance(value, bool) else float("nan")
    if number != int(number) if number == number and abs(number) != float("inf") else True:
        raise ValueError(f"{name} must be a whole number, not {value!r}")
    return int(number)


@dataclass(frozen=True)
class Stage:
    seq_len: int
    micro_batch: int
    until_tokens: int
    grad_accum: int | None = None


def stage_problems(stages: list[Stage], total_tokens: int, grad_accum: int = 1) -> list[str]:
    """What is wrong with a plan of stages; an empty list if nothing is."""
    if not stages:
        return ["there is no stage"]
    out = []
    per_step = {s.seq_len * s.micro_batch * (s.grad_accum or grad_accum) for s in stages}
    if len(per_step) > 1:
        out.append(f"tokens a step differ between stages: {sorted(per_step)}")
    longest = max(s.seq_len for s in stages)
    if bad := [s.seq_len for s in stages if longest % s.seq_len]:
        out.append(f"lengths {bad} do not divide {longest}")
    ends = [s.until_tokens for s in stages]
    if sorted(set(ends)) != ends:
        out.append(f"ends of stages do not rise: {ends}")
    if ends[-1] < total_tokens:
        out.append(f"the last stage ends at {ends[-1]}, before {total_tokens}")
    return out


def check_stages(stages: list[Stage], total_tokens: int, grad_accum: int = 1) -> None:
    if problems := stage_problems(stages, total_tokens, grad_accum):
        raise ValueError("; ".join(problems))


def rising(table: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, ok): whether ``value`` rises strictly along ``order`` for each key; one row a stage."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
    return table.groupBy(key).agg(pairs.alias("v")).select(key, F.forall(F.sequence(F.lit(0), F.greatest(F.size("v") - 2, F.lit(0))), lambda i: F.coalesce(F.get("v", i) < F.get("v", i + 1), F.lit(True))).alias("ok"))


@dataclass(frozen=True)
class Model:
    """Sizes that decide the cost of a model with two kinds of mixing layers."""

    width: int
    ffn: int
    vocab: int
    attention_layers: int
    heads: int
    kv_heads: int
    head_size: int
    linear_layers: int = 0
    linear_qk_heads: int = 0
    linear_v_heads: int = 0
    linear_head_size: int = 0
    extra_heads: int = 0  # further predicted tokens, each with an attention layer and a projection of its own
    branches: int = 0
    branch_rank: int = 0

    def weights(self) -> int:
        """Weights of all matrices that each token is multiplied with, heads over the vocabulary included."""
        d = self.width
        q, kv = self.heads * self.head_size, self.kv_heads * self.head_size
        attention = 3 * d * q + 2 * d * kv  # query, gate and output; key and value
        lq, lv = self.linear_qk_heads * self.linear_head_size, self.linear_v_heads * self.linear_head_size
        linear = d * (2 * lq + 3 * lv + 2 * self.linear_v_heads)
        feed = 3 * d * self.ffn
        side = 2 * (d * self.branch_rank * (1 + self.branches) + d * self.branches) if self.branches else 0
        layers = self.attention_layers * (attention + feed + side) + self.linear_layers * (linear + feed + side)
        return layers + self.extra_heads * (2 * d * d + attention + feed) + (1 + self.extra_heads) * self.vocab * d

    def flops(self, seq_len: Column) -> Column:
        """Operations of training (forward and backward, three times the forward) for each token at a length."""
        pairs = (self.attention_layers + self.extra_heads) * self.heads * self.head_size
        state = 2 * self.linear_layers * self.linear_v_heads * self.linear_head_size**2
        return (F.lit(6 * (self.weights() + state)) + F.lit(6 * pairs) * seq_len).cast("double")

    def utilization(self, seq_len: Column, tokens_per_second: Column, peak_tflops: float) -> Column:
        """Share of the peak that is used."""
        return self.flops(seq_len) * tokens_per_second / F.lit(peak_tflops * 1e12)


def differences(saved: DataFrame, current: DataFrame, key: str, ignored: list[str]) -> DataFrame:
    """(key, name, saved, current) of every setting whose value differs; ``saved`` and ``current`` hold (key, name, value).

    Settings that only concern the execution (``ignored``) may differ.
    """
    both = saved.withColumnRenamed("value", "saved").join(current.withColumnRenamed("value", "current"), [key, "name"], "full")
    return both.filter(~F.col("name").isin(ignored) & ~F.col("saved").eqNullSafe(F.col("current")))
