"""Files of given names and bytes, one a row, as a data source that tasks write.

    write_named_files(df, "hdfs:///out", name="file", content="text", folder="route")

A task writes each of its rows under a hidden name beside its place and gives all of them their names when its last
row is written; an attempt that fails removes what it wrote and leaves nothing. It also writes its part of the
manifest, a JSON line a file (folder, name, bytes, sha256, and the table's other columns), and reports that to the
driver, which gets a few numbers from each task and no rows. When all tasks are done the driver puts manifest.json in
place by one rename: the list of the parts, with counts. Readers that begin at manifest.json see a whole export or
the one before it. An export that fails removes the files that its finished tasks have written.

Names and folders must be plain: no empty ones, no separators, nothing that begins with a dot or underscore; and a
folder has each name once, which is counted beforehand. Such rows fail the write before the first file. Null content
is an empty file. A file of that name from an earlier export is replaced. The store is reached by its URI through
Arrow's file systems, so executors need no JVM for it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

_PLAIN = r"^[^/\\\x00-\x1F._][^/\\\x00-\x1F]*$"


def store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """What a task has finished: its part of the manifest, files and bytes."""

    part: str
    files: int
    size: int


class NamedFiles(DataSource):
    """Options: path. Columns: __folder, __name, __content (binary), and others for the manifest."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options["path"].rstrip("/"), self.options["job"])


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, job: str):
        self.path, self.job = path, job

    def write(self, iterator: Iterator) -> Written:
        fs, root = store(self.path)
        token = uuid.uuid4().hex
        hidden: list[tuple[str, str]] = []  # as written, and its name
        placed: list[str] = []
        size, made = 0, set()
        part = f"{root}/_manifest/{self.job}/{token}.jsonl"
        try:
            fs.create_dir(f"{root}/_manifest/{self.job}", recursive=True)
            with fs.open_output_stream(part) as lines:
                for batch in iterator:
                    others = [c for c in batch.schema.names if c not in ("__folder", "__name", "__content")]
                    for row in batch.to_pylist():
                        folder, name, body = row["__folder"], row["__name"], row["__content"] or b""
                        at = f"{root}/{folder}" if folder else root
                        if at not in made:
                            fs.create_dir(at, recursive=True)
                            made.add(at)
                        hidden.append((f"{at}/.{name}.{token}", f"{at}/{name}"))
                        with fs.open_output_stream(hidden[-1][0]) as out:
                            out.write(body)
                        size += len(body)
                        line = {"folder": folder, "name": name, "bytes": len(body), "sha256": hashlib.sha256(body).hexdigest()} | {c: row[c] for c in others}
                        lines.write(json.dumps(line, ensure_ascii=False, default=str).encode() + b"\n")
            for old, new in hidden:
                fs.move(old, new)
                placed.append(new)
        except BaseException:
            _remove(fs, [part, *(old for old, _ in hidden[len(placed) :]), *placed])
            raise
        if not hidden:
            _remove(fs, [part])
        return Written(part.removeprefix(f"{root}/"), len(hidden), size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = store(self.path)
        done = [m for m in messages if m and m.files]
        body = {"files": sum(m.files for m in done), "bytes": sum(m.size for m in done), "parts": sorted(m.part for m in done)}
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/.manifest.{self.job}") as out:
            out.write(json.dumps(body, indent=2).encode())
        fs.move(f"{root}/.manifest.{self.job}", f"{root}/manifest.json")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = store(self.path)
        for m in messages:
            if m and m.files:
                with fs.open_input_stream(f"{root}/{m.part}") as lines:
                    own = [json.loads(x) for x in lines.read().splitlines()]
                _remove(fs, [*(f"{root}/{x['folder']}/{x['name']}" if x["folder"] else f"{root}/{x['name']}" for x in own), f"{root}/{m.part}"])


def _remove(fs: pafs.FileSystem, paths: list[str]) -> None:
    def one(path: str) -> None:
        if fs.get_file_info(path).type == pafs.FileType.File:
            fs.delete_file(path)

    with ThreadPoolExecutor(16) as pool:
        list(pool.map(one, paths))


def write_named_files(df: DataFrame, path: str, name: str, content: str, folder: Column | None = None) -> None:
    """Writes each row's content (text as UTF-8, or bytes) to path/folder/name; other columns go to the manifest."""
    spark = df.sparkSession
    where = folder.cast("string") if folder is not None else F.lit("")
    rows = df.withColumns({"__folder": where, "__name": F.col(name).cast("string"), "__content": F.col(content).cast("binary")})
    plain = F.coalesce(F.col("__name").rlike(_PLAIN), F.lit(False))
    if folder is not None:
        plain &= F.coalesce(F.col("__folder").rlike(_PLAIN), F.lit(False))
    wrong = rows.groupBy("__folder", "__name").agg(F.count("*").alias("n"), F.first(plain).alias("plain")).where("n > 1 or not plain").limit(3).collect()
    if wrong:
        raise ValueError(f"names must be plain and once in a folder: {[(r['__folder'], r['__name'], r['n']) for r in wrong]}")
    spark.dataSource.register(NamedFiles)
    rows.drop(name, content).write.format("named_files").mode("append").option("path", path).option("job", uuid.uuid4().hex).save()


def read_manifest(spark, path: str) -> DataFrame:
    """The files of the last whole export of a folder: folder, name, bytes, sha256 and the exported columns."""
    fs, root = store(path)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        parts = json.loads(f.read())["parts"]
    base = path if "://" in path else f"file://{path}"
    known = "folder string, name string, bytes bigint, sha256 string"
    return spark.read.json([f"{base}/{p}" for p in parts]) if parts else spark.createDataFrame([], known)
