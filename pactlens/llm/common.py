"""Helpers that several operators share: the shared folder, work tables, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Words of the deduplication operators: runs of anything but ASCII white space.
ASCII_SPACE = b" \t\n\x0b\x0c\r"

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session does not name one, local mode gets a temporary folder; on a
    cluster that would be each machine's own, so it is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="pactlens-")
    return _own[app]


def new_dir(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def work_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, so a result used
    twice is computed once and a lost executor costs one re-read. The shuffle files
    behind it are freed when it is written.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Let Python workers get at most so many rows at once: with whole texts in them,
    the usual ten thousand would take hundreds of MB of a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def drop_work_table(df: DataFrame) -> None:
    """Delete the files of a work table that nothing will read any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder's URI; a bare path is local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: near keys become unrelated ones."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, kept for the words seen last.

    ``limit`` bounds the memory; beyond it the memo starts anew.
    """

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) >= self.limit:
            self.clear()
        value = xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """The 64-bit hash of every run of ``n`` words, from the words' hashes.

    Positions weigh in by powers of an odd number, so order counts; doubling the
    span needs log2(n) passes instead of n.
    """
    if len(words) < n:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    power, have, out, done = mix(words), 1, None, 0
    left = n
    while True:
        if left & 1:
            if out is None:
                out, done = power, have
            else:
                size = len(words) - done - have + 1
                out = power[:size] * np.uint64(pow(base, done, 1 << 64)) + out[have : have + size]
                done += have
        left >>= 1
        if not left:
            return mix(out)
        size = len(words) - 2 * have + 1
        power = power[:size] * np.uint64(pow(base, have, 1 << 64)) + power[have : have + size]
        have *= 2


def rolling_many(words: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """rolling() for several lengths, which share the passes over doubled spans."""
    base = 0x9E3779B97F4A7C15
    lengths = [n for n in lengths if n <= len(words)]
    levels = [mix(words)] if lengths else []
    while lengths and 2 << len(levels) - 1 <= max(lengths):
        have, power = 1 << len(levels) - 1, levels[-1]
        size = len(words) - 2 * have + 1
        levels.append(power[:size] * np.uint64(pow(base, have, 1 << 64)) + power[have : have + size])
    found = {}
    for n in lengths:
        out, done = None, 0
        for k, power in enumerate(levels):
            have = 1 << k
            if n & have:
                size = len(words) - done - have + 1
                out = power if out is None else power[:size] * np.uint64(pow(base, done, 1 << 64)) + out[have : have + size]
                done += have
        found[n] = mix(out)
    return found
