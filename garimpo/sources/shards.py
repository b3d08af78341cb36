"""Binary token shards as a Spark data source: little-endian unsigned integers with a JSON sidecar.

``spark.read.format("token_shards").load(folder)`` gives (path, pos, tokens): blocks of tokens of each shard, one
partition a shard, or for several small ones. Options: ``dtype`` (uint32 or uint16), ``block`` (tokens a row), ``check`` (false skips the sidecar).
``df.write.format("token_shards").mode("append").save(folder)`` takes (shard_id int, shard_pos bigint, tokens
array<bigint>, and optionally source string), each shard within one partition and in order; files appear under their
names only when the job commits. The sidecar then also tells how many tokens each source has in the shard.

Folders are paths that all executors and the driver see under the same name (a mounted shared folder).
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "path string, pos bigint, tokens array<bigint>"
WIDTH = {"uint32": 4, "uint16": 2}
TASK_BYTES = 1 << 22  # small shards share a task up to this size


def sidecar_of(path: str) -> str:
    return os.path.splitext(path)[0] + ".json"


def check_shard(path: str, dtype: str = "uint32") -> int:
    """Number of tokens; errors if the size or the sidecar don't fit."""
    size = os.path.getsize(path)
    if size % WIDTH[dtype]:
        raise ValueError(f"{path}: size {size} is no multiple of {WIDTH[dtype]}")
    with open(sidecar_of(path)) as f:
        side = json.load(f)
    if side.get("dtype") != dtype:
        raise ValueError(f"{path}: dtype {side.get('dtype')}, not {dtype}")
    if side.get("n_tokens") != size // WIDTH[dtype]:
        raise ValueError(f"{path}: {size // WIDTH[dtype]} tokens, the sidecar says {side.get('n_tokens')}")
    return size // WIDTH[dtype]


def resolve(patterns: list[str]) -> list[str]:
    """Files of the patterns, sorted within each; a pattern without files is an error."""
    out = []
    for p in patterns:
        found = sorted(glob.glob(p))
        if not found:
            raise FileNotFoundError(p)
        out += found
    return out


@dataclass
class ShardPartition(InputPartition):
    paths: list[str]


class ShardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.dtype = options.get("dtype", "uint32")
        self.block = int(options.get("block", 65_536))
        self.check = options.get("check", "true").lower() != "false"

    def partitions(self) -> list[InputPartition]:
        out, room = [], 0
        for p in resolve([os.path.join(self.folder, "*.bin")]):
            size = os.path.getsize(p)
            if not out or size > room:
                out.append(ShardPartition([]))
                room = TASK_BYTES
            out[-1].paths.append(p)
            room -= size
        return out

    def read(self, partition: ShardPartition) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            yield from self.read_shard(path)

    def read_shard(self, path: str) -> Iterator[pa.RecordBatch]:
        if self.check:
            check_shard(path, self.dtype)
        if os.path.getsize(path) == 0:
            return
        data = np.memmap(path, dtype=f"<u{WIDTH[self.dtype]}", mode="r")
        for at in range(0, len(data), self.block):
            part = np.asarray(data[at : at + self.block]).astype(np.int64)
            tokens = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at], pa.int64()), tokens], ["path", "pos", "tokens"])


@dataclass
class Written(WriterCommitMessage):
    files: list


class ShardWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder = options["path"]
        self.dtype = options.get("dtype", "uint32")
        self.extra = {k: int(options[k]) for k in ("eos_id", "unit_len") if k in options}
        self.overwrite = overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        done, now, out, digest, n, by = [], None, None, None, 0, {}

        def close():
            if out is not None:
                out.close()
                done.append((now, out.name, n, digest.hexdigest(), by))

        for r in rows:
            shard, pos, tokens = r["shard_id"], r["shard_pos"], r["tokens"]
            if shard != now:
                close()
                now, n, digest, by = shard, 0, hashlib.sha256(), {}
                out = open(os.path.join(self.folder, f".tmp-{uuid.uuid4().hex}"), "wb")
            if pos != n:
                raise ValueError(f"shard {shard}: tokens at {pos} follow {n}")
            x = np.asarray(tokens, np.int64)
            if len(x) and (x.min() < 0 or x.max() >= 1 << (8 * WIDTH[self.dtype])):
                raise ValueError(f"shard {shard}: token out of range")
            raw = x.astype(f"<u{WIDTH[self.dtype]}").tobytes()
            out.write(raw)
            digest.update(raw)
            n += len(x)
            if "source" in r:
                name = r["source"] or "unknown"
                by[name] = by.get(name, 0) + len(x)
        close()
        return Written(done)

    def commit(self, messages: list) -> None:
        files = [f for m in messages if m for f in m.files]
        if len({f[0] for f in files}) != len(files):
            self.abort(messages)
            raise ValueError("a shard was written by several tasks")
        if self.overwrite:
            for p in glob.glob(os.path.join(self.folder, "shard_*.*")):
                os.remove(p)
        for shard, temporary, n, digest, by in files:
            path = os.path.join(self.folder, f"shard_{shard:05d}.bin")
            os.replace(temporary, path)
            with open(temporary + ".json", "w") as f:
                json.dump({"n_tokens": n, "dtype": self.dtype, **self.extra, **({"sources": dict(sorted(by.items()))} if by else {}), "sha256": digest}, f)
            os.replace(temporary + ".json", sidecar_of(path))

    def abort(self, messages: list) -> None:
        for m in messages:
            for _, temporary, *_ in m.files if m else []:
                if os.path.exists(temporary):
                    os.remove(temporary)


class TokenShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ShardReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ShardWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenShards)


def read_shards(spark: SparkSession, folder: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("token_shards").options(**options).load(folder)


def append_shards(tokens: DataFrame, folder: str, eos: int, unit_len: int, dtype: str = "uint32") -> None:
    """``write_shards`` behind the shards that the folder has: ``tokens`` counts its own shards from 0."""
    have = len(glob.glob(os.path.join(folder, "shard_*.bin")))
    write_shards(tokens.withColumn("shard_id", (F.col("shard_id") + have).cast("int")), folder, eos, unit_len, dtype)


def write_shards(tokens: DataFrame, folder: str, eos: int, unit_len: int, dtype: str = "uint32") -> None:
    """Write ``tokens(shard_id, shard_pos, tokens[, source])``: each shard in one task, small ones together, sorted within."""
    register(tokens.sparkSession)
    sizes = tokens.groupBy("shard_id").agg(F.sum(F.size("tokens")).alias("n"))
    n, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = min(n, total * WIDTH[dtype] // TASK_BYTES + 1)
    placed = tokens.repartition(max(tasks, 1), "shard_id").sortWithinPartitions("shard_id", "shard_pos")
    placed.select("shard_id", "shard_pos", "tokens", *(["source"] if "source" in tokens.columns else [])).write.format("token_shards").mode("append").options(eos_id=eos, unit_len=unit_len, dtype=dtype).save(folder)
