"""Panels written as parts that are committed together: a manifest says which parts there are, in which order, and what they hold.

Each task writes a part in a folder of the job's own and reports its rows and SHA-256. When all have, the parts get their final names in the order of their
partitions and the manifest is written last, with a digest per part and the root of their Merkle tree; so a folder with a manifest is whole, and a failed job leaves
neither. `verified` reads a folder through its manifest and checks every part. Files may be in any file system that Arrow writes to.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import csv as arrow_csv
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from marlstone.schema import PANEL
from marlstone.shipping import ship_package

MANIFEST = "manifest.json"
#: Bytes of a file that are held at once.
CHUNK = 1 << 20


def store_of(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), root)


def merkle_root(leaves: list[str]) -> str:
    """The root over hexadecimal SHA-256 digests: each pair's digests are hashed together, and one without a partner goes up as it is."""
    level = [bytes.fromhex(x) for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(level[k] + level[k + 1]).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0].hex()


def file_digest(store: fs.FileSystem, path: str) -> tuple[str, int]:
    """(SHA-256, bytes) of a file of any size, a chunk at a time."""
    h, n = hashlib.sha256(), 0
    with store.open_input_stream(path) as f:
        while block := f.read(CHUNK):
            h.update(block)
            n += len(block)
    return h.hexdigest(), n


class _Hashed:
    """A stream that is hashed as it is written."""

    def __init__(self, out: Any) -> None:
        self.out, self.hash, self.closed = out, hashlib.sha256(), False

    def write(self, data: bytes) -> int:
        data = bytes(data)
        self.hash.update(data)
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    rows: int
    sha256: str


class PartWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.root, self.names = options["path"], names
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, root = store_of(self.root)
        number = TaskContext.get().partitionId()
        path = f"{root}/{self.job}/{number:05d}-{uuid.uuid4().hex}.csv"  # another attempt has another name
        store.create_dir(f"{root}/{self.job}", recursive=True)
        rows = 0
        with store.open_output_stream(path) as f:
            out = _Hashed(f)
            head = io.StringIO()
            csv.writer(head, lineterminator="\n").writerow(self.names)
            out.write(head.getvalue().encode())
            plain = arrow_csv.WriteOptions(include_header=False, quoting_style="needed")
            for b in iterator:
                rows += b.num_rows
                buffer = io.BytesIO()
                arrow_csv.write_csv(b, buffer, plain)
                out.write(buffer.getvalue())
        return Part(number, path, rows, out.hash.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        store, root = store_of(self.root)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        listed = []
        for k, m in enumerate(parts):
            name = f"part-{k:05d}-{self.job[5:13]}.csv"
            store.move(m.path, f"{root}/{name}")
            listed.append({"name": name, "rows": m.rows, "sha256": m.sha256})
        whole = {"columns": self.names, "parts": listed, "rows": sum(p["rows"] for p in listed), "root": merkle_root([p["sha256"] for p in listed])}
        held = f"{root}/{self.job}/{MANIFEST}"
        store.create_dir(f"{root}/{self.job}", recursive=True)
        with store.open_output_stream(held) as f:
            f.write((json.dumps(whole, sort_keys=True, indent=2) + "\n").encode())
        store.move(held, f"{root}/{MANIFEST}")
        store.delete_dir(f"{root}/{self.job}")

    def abort(self, messages: list[Part | None]) -> None:
        store, root = store_of(self.root)
        if store.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.job}")


class CommittedPanel(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed_panel"

    def writer(self, schema: Any, overwrite: bool) -> PartWriter:
        return PartWriter(dict(self.options), schema.fieldNames())


def write_committed(panel: DataFrame, root: str, parts: int | None = None) -> dict[str, Any]:
    """Writes the panel in (time, asset) order and returns its manifest. A folder that has a manifest is not written over. parts: how many ranges of keys, if
    that isn't left to Spark."""
    spark = panel.sparkSession
    store, path = store_of(root)
    if store.get_file_info(f"{path}/{MANIFEST}").type != fs.FileType.NotFound:
        raise FileExistsError(f"{root} already has a manifest")
    ship_package(spark)
    spark.dataSource.register(CommittedPanel)
    key = ["decision_time_ms", "asset"]
    ordered = panel.repartitionByRange(parts, *key).sortWithinPartitions(*key) if parts else panel.orderBy(*key)
    ordered.write.format("committed_panel").mode("append").option("path", root).save()
    return manifest(root)


def manifest(root: str) -> dict[str, Any]:
    store, path = store_of(root)
    with store.open_input_stream(f"{path}/{MANIFEST}") as f:
        return json.loads(f.read())


def _digests(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(root)
        for b in batches:
            found = [file_digest(store, f"{path}/{n}") for n in b.column("name").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array([h for h, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["name", "sha256", "bytes"])

    return run


def digests(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(name, sha256, bytes) of files under a folder, of any size, a task for each."""
    ship_package(spark)
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    return rows.repartition(max(1, len(names))).mapInArrow(_digests(root), "name string, sha256 string, bytes long")


def verified(spark: SparkSession, root: str) -> DataFrame:
    """The panel's rows, after every part's digest, the root and the number of rows have been checked."""
    said = manifest(root)
    names = [p["name"] for p in said["parts"]]
    found = {r.name: r.sha256 for r in digests(spark, root, names).collect()}
    if wrong := [p["name"] for p in said["parts"] if found[p["name"]] != p["sha256"]]:
        raise ValueError(f"{wrong[0]} isn't what the manifest says")
    if merkle_root([found[n] for n in names]) != said["root"]:
        raise ValueError("the parts' digests don't make up the manifest's root")
    rows = spark.read.schema(PANEL).option("header", "true").option("enforceSchema", "false").option("nullValue", "").csv([f"{root}/{n}" for n in names])
    if (n := rows.count()) != said["rows"]:
        raise ValueError(f"{n} rows, where the manifest says {said['rows']}")
    return rows
