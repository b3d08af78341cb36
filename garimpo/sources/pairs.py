"""Binary files of preference pairs as a Spark data source.

A file has a header of 32 bytes (magic ``DPO1``, sequence length, number of pairs, vocabulary size, 16 reserved bytes) and
fixed-size records: inputs and targets of the chosen and of the rejected answer as 16-bit tokens, then two 32-bit log
probabilities. Record ``k`` begins at ``32 + k * (8 * seq_len + 8)``, so a file is read in ranges of records.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER = "<4sIII16s"
MAGIC = b"DPO1"
ARRAYS = ("chosen_input", "chosen_target", "rejected_input", "rejected_target")
SCHEMA = "pair bigint, " + ", ".join(f"{a} array<int>" for a in ARRAYS) + ", chosen_logp float, rejected_logp float"


def read_header(path: str) -> tuple[int, int, int]:
    """(sequence length, pairs, vocabulary size); an error if the file doesn't fit its header."""
    with open(path, "rb") as f:
        head = f.read(struct.calcsize(HEADER))
    if len(head) < 32:
        raise ValueError(f"{path}: no header")
    magic, seq_len, n, vocab, _ = struct.unpack(HEADER, head)
    if magic != MAGIC:
        raise ValueError(f"{path}: magic {magic!r}")
    if os.path.getsize(path) != 32 + n * (8 * seq_len + 8):
        raise ValueError(f"{path}: size doesn't fit {n} pairs")
    return seq_len, n, vocab


@dataclass
class Range(InputPartition):
    first: int
    last: int


class PairReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("block", 65_536))

    def partitions(self) -> list[InputPartition]:
        _, n, _ = read_header(self.path)
        return [Range(k, min(k + self.block, n)) for k in range(0, n, self.block)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        seq_len, _, _ = read_header(self.path)
        kind = np.dtype([("tokens", "<u2", (4, seq_len)), ("logp", "<f4", (2,))])
        n = partition.last - partition.first
        if not n:
            return
        got = np.memmap(self.path, dtype=kind, mode="r", offset=32 + partition.first * kind.itemsize, shape=(n,))
        cuts = pa.array(np.arange(n + 1) * seq_len, pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(np.ascontiguousarray(got["tokens"][:, i, :]).reshape(-1).astype(np.int32))) for i in range(4)]
        logp = [pa.array(np.ascontiguousarray(got["logp"][:, i])) for i in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first, partition.last)), *lists, *logp], ["pair", *ARRAYS, "chosen_logp", "rejected_logp"])


class PreferencePairs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "preference_pairs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PairReader(self.options)


def read_pairs(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(PreferencePairs)
    return spark.read.format("preference_pairs").options(**options).load(path)


def write_pairs(pairs: DataFrame, path: str, seq_len: int, vocab: int) -> None:
    """Write ``pairs`` (columns of ``SCHEMA``) in order of ``pair`` to one file, streamed partition by partition."""
    n = pairs.count()
    temporary = f"{path}.tmp"
    with open(temporary, "wb") as f:
        f.write(struct.pack(HEADER, MAGIC, seq_len, n, vocab, bytes(16)))
        for r in pairs.orderBy("pair").toLocalIterator():
            for a in ARRAYS:
                x = np.asarray(r[a], np.int64)
                if len(x) != seq_len or len(x) and (x.min() < 0 or x.max() > 65535):
                    raise ValueError(f"pair {r['pair']}: {a} must hold {seq_len} tokens of 16 bits")
                f.write(x.astype("<u2").tobytes())
            f.write(struct.pack("<ff", r["chosen_logp"], r["rejected_logp"]))
    os.replace(temporary, path)
