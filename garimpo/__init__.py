"""garimpo: Spark-native preparation and analysis of language-model training corpora."""

from __future__ import annotations

from importlib import import_module

__version__ = "0.2.0"

#: What the package offers by name, and where it stands; modules are imported when first used.
_WHERE = {
    "prepare": "plans.pipeline", "filter_document": "operators.quality", "with_reason": "operators.quality", "legacy_quality": "operators.quality", "greedy_dedup": "operators.dedup", "windowed_dedup": "operators.dedup",
    "exact_dedup": "operators.dedup", "held_out_leaks": "operators.dedup", "signatures": "operators.dedup", "interleave": "operators.mixing", "union_sources": "operators.mixing", "check_weights": "operators.mixing",
    "encode": "operators.tokenizer", "decode": "operators.tokenizer", "select_vocabulary": "operators.vocabulary", "read_shards": "sources.shards", "write_shards": "sources.shards", "check_shard": "sources.shards",
    "StreamDedup": "streaming.dedup",
}
_NAMES = {"select_vocabulary": "select"}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(import_module(f"garimpo.{_WHERE[name]}"), _NAMES.get(name, name))
    raise AttributeError(name)
