"""Hidden states as NumPy shards, read and written as a Spark data source.

A folder per model holds `uids_<shard>.json`, a list of text ids, and `h_<shard>_L<layer>.npy`,
one row per id. A file is a partition; filters on tag and layer choose files before any is read,
and rows come in batches, so neither a shard nor a layer is ever whole in memory. The writer
stages its files and moves them into place when all tasks are done.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)

NAME = "numpy_shards"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SCHEMA = "tag string, layer int, uid string, h array<float>"
BATCH_BYTES = 16 << 20
STAGED = "_staged"


@dataclass
class Shard(InputPartition):
    """One layer file of one shard."""

    tag: str
    layer: int
    shard: str
    folder: str


@dataclass
class Written(WriterCommitMessage):
    """Staged files of one task: (tag, where the files lie, layers of each part)."""

    parts: list


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ShardReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.allowed = path, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership on tag and layer choose files; everything else stays with Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in ("tag", "layer"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.allowed[column] = self.allowed.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[Shard]:
        system, root = _place(self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            named = re.fullmatch(r"h_(\w+?)_L(\d+)\.npy", info.base_name)
            folder = info.path.rsplit("/", 1)[0]
            tag = folder[len(root.rstrip("/")) :].strip("/")
            if named and tag and not tag.startswith("_"):
                found.append(Shard(tag, int(named[2]), named[1], folder))
        return [p for p in found if all(getattr(p, c) in v for c, v in self.allowed.items())]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.path)
        with system.open_input_stream(f"{partition.folder}/uids_{partition.shard}.json") as f:
            uids = json.loads(f.read())
        name = f"{partition.folder}/h_{partition.shard}_L{partition.layer}.npy"
        with system.open_input_file(name) as f:
            version = np.lib.format.read_magic(f)
            shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            if len(shape) != 2 or by_column or shape[0] != len(uids):
                raise ValueError(f"{name}: shape {shape} for {len(uids)} ids")
            step = max(BATCH_BYTES // max(shape[1] * kind.itemsize, 1), 1)
            for a in range(0, shape[0], step):
                some = uids[a : a + step]
                rows = np.frombuffer(f.read(len(some) * shape[1] * kind.itemsize), kind).astype(np.float32)
                ends = pa.array(np.arange(len(some) + 1) * shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.tag] * len(some)), pa.array([partition.layer] * len(some), pa.int32()), pa.array(some, pa.string()),
                     pa.ListArray.from_arrays(ends, pa.array(rows))], ["tag", "layer", "uid", "h"])


class ShardWriter(DataSourceArrowWriter):
    """A task's rows become one shard per model; layers with other ids than the first get their own."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _place(self.path)
        held: dict[tuple[str, int], list] = {}
        for batch in iterator:
            for tag, layer, uid, h in zip(*(batch[c].to_pylist() for c in ("tag", "layer", "uid")), (x.values.to_numpy() for x in batch["h"]), strict=True):
                held.setdefault((tag, layer), []).append((uid, h))
        shards: dict[tuple, list[int]] = {}
        for (tag, layer), rows in held.items():
            rows.sort(key=lambda r: r[0])
            shards.setdefault((tag, tuple(r[0] for r in rows)), []).append(layer)
        parts = []
        for (tag, uids), layers in shards.items():
            folder = f"{root}/{STAGED}-{self.run}/{uuid.uuid4().hex}"
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/uids.json") as f:
                f.write(json.dumps(uids).encode())
            for layer in layers:
                with system.open_output_stream(f"{folder}/L{layer}.npy") as f:
                    np.lib.format.write_array(f, np.array([h for _, h in held[tag, layer]], np.float32), allow_pickle=False)
            parts.append((tag, folder, layers))
        return Written(parts)

    def _tags(self, system: fs.FileSystem, root: str) -> list[fs.FileInfo]:
        there = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [i for i in there if i.type == fs.FileType.Directory and not i.base_name.startswith("_")]

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _place(self.path)
        taken: dict[str, int] = {}
        for old in self._tags(system, root):
            if self.overwrite:
                system.delete_dir(old.path)
            else:
                numbers = [int(m[1]) for i in system.get_file_info(fs.FileSelector(old.path)) if (m := re.fullmatch(r"uids_(\d+)\.json", i.base_name))]
                taken[old.base_name] = max(numbers, default=-1) + 1
        for tag, folder, layers in sorted(p for m in messages if m for p in m.parts):
            n = taken.get(tag, 0)
            taken[tag] = n + 1
            system.create_dir(f"{root}/{tag}", recursive=True)
            for layer in layers:
                system.move(f"{folder}/L{layer}.npy", f"{root}/{tag}/h_{n}_L{layer}.npy")
            system.move(f"{folder}/uids.json", f"{root}/{tag}/uids_{n}.json")
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_place(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        staged = f"{root}/{STAGED}-{self.run}"
        if system.get_file_info(staged).type == fs.FileType.Directory:
            system.delete_dir(staged)


class NumpyShards(DataSource):
    """Options: path, a folder that all workers see."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], overwrite)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(tag, layer, uid, h) of all shards; filters on tag and layer skip files."""
    spark.dataSource.register(NumpyShards)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format(NAME).option("path", path).load()


def write_shards(hidden: DataFrame, path: str, shards: int, mode: str = "overwrite") -> None:
    """hidden as `shards` shards of each model; a text's layers go to one shard."""
    hidden.sparkSession.dataSource.register(NumpyShards)
    dealt = hidden.selectExpr("tag", "layer", "uid", "CAST(h AS array<float>) AS h").repartition(shards, "uid")
    dealt.write.format(NAME).option("path", path).mode(mode).save()
