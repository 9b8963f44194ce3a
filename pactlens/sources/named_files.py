"""A writer that makes one file of a given name for each row.

Spark's own writers name files by task. Here a task writes its files into a folder of its
attempt, moves them to their names once all are written, and reports the attempt; the
commit keeps the manifests of the attempts that count and removes every other trace. So a
task that is repeated or lost leaves no file of its own, and a file under its name is
always whole. Names are the caller's: equal names replace each other, the last one stays.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

ATTEMPTS, MANIFEST = "_attempts", "_manifest"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a folder's URI; a bare path is local."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: int


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator) -> Written:
        store, root = filesystem(self.folder)
        attempt = uuid.uuid4().hex
        own = f"{root}/{ATTEMPTS}/{attempt}"
        store.create_dir(own, recursive=True)
        names = []
        for row in iterator:
            name, content = row[0], row[1]
            if not name or name in (".", "..") or "/" in name or name.startswith("_"):
                raise ValueError(f"no name for a file: {name!r}")
            with store.open_output_stream(f"{own}/{name}") as out:
                out.write((content or "").encode("utf-8", "surrogatepass"))
            names.append(name)
        store.create_dir(f"{root}/{MANIFEST}", recursive=True)
        for name in dict.fromkeys(names):
            store.move(f"{own}/{name}", f"{root}/{name}")
        with store.open_output_stream(f"{root}/{MANIFEST}/{attempt}.jsonl") as out:
            out.write("".join(json.dumps(n) + "\n" for n in names).encode())
        return Written(attempt, len(names))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.folder)
        good = [m for m in messages if m is not None]
        self._clear(store, root, {m.attempt for m in good})
        with store.open_output_stream(f"{root}/{MANIFEST}/_committed.json") as out:
            out.write(json.dumps({"files": sum(m.files for m in good), "parts": sorted(m.attempt for m in good)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.folder)
        for m in messages:
            part = m and f"{root}/{MANIFEST}/{m.attempt}.jsonl"
            if part and store.get_file_info(part).type == fs.FileType.File:
                for name in map(json.loads, store.open_input_stream(part).read().decode().splitlines()):
                    if store.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                        store.delete_file(f"{root}/{name}")
        self._clear(store, root, set())

    @staticmethod
    def _clear(store: fs.FileSystem, root: str, keep: set[str]) -> None:
        if store.get_file_info(f"{root}/{ATTEMPTS}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{ATTEMPTS}")
        for info in store.get_file_info(fs.FileSelector(f"{root}/{MANIFEST}", allow_not_found=True)):
            if info.base_name.endswith(".jsonl") and info.base_name[:-6] not in keep:
                store.delete_file(info.path)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"])


def write_named(files: DataFrame, folder: str) -> None:
    """``files`` (name, content) as files of these names below ``folder``."""
    spark = files.sparkSession
    spark.dataSource.register(NamedFiles)
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    files.select(F.col("name").cast("string").alias("name"), F.col("content").cast("string").alias("content")).write.format("named_files").mode("append").save(folder)


def stem(doc_id: Column) -> Column:
    """A document's name: the last part of its id, without its ending."""
    return F.regexp_extract(doc_id.cast("string"), r"([^/]+?)(?:\.[^./]*)?/?$", 1)


def with_file_stem(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, ..) with ``stem``, for file names: of documents that share one,
    the first keeps it, the others have a hash of their id behind it."""
    named = rows.withColumn("stem", F.when(stem(F.col("doc_id")) == "", "document").otherwise(F.regexp_replace(stem(F.col("doc_id")), "^_", "-")))
    nth = F.row_number().over(Window.partitionBy("stem").orderBy(F.col("doc_id").cast("string")))
    return named.withColumn("stem", F.when(nth == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("-"), F.lower(F.hex(F.xxhash64("doc_id"))))))
