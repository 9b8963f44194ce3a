"""Intake of new documents as a stream: each micro-batch is one batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract, report
from ..plans.analysis import analyse
from ..session import stored
from ..sources.readers import decode_text, write_json


def stream_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, raw_text) of text files as they arrive."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.{[tT][xX][tT],[tT][eE][xX][tT]}").load(folder)
    return rows.select("path", decode_text(F.col("content")).alias("raw_text"))


def run_batches(docs: DataFrame, checkpoint: str, process: Callable[[DataFrame], None]) -> StreamingQuery:
    """Process what has arrived and stop; the checkpoint keeps files from being read twice."""
    return docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: process(batch)).start()


def stream_analysis(spark: SparkSession, folder: str, out: str, checkpoint: str, extractor=None, attempts: int = extract.ATTEMPTS, every: str | None = None) -> StreamingQuery:
    """Reports of documents as they arrive, by name below ``out``; what has arrived is
    done and the stream stops, or it goes on ``every`` so often ("1 minute").

    Everything of a batch lies below its number, so a batch that is repeated after a
    failure writes the same again: its answers, its errors, and the files by their names.
    """

    def process(batch: DataFrame, number: int) -> None:
        store = f"{out}/_store/{number}"
        docs = stored(batch.select(F.col("path").alias("doc_id"), "raw_text"), f"{store}/documents")
        done = analyse(docs, extractor, store, attempts)
        report.write_reports(stored(done["report"], f"{store}/report"), out)
        write_json(done["errors"], f"{out}/_errors/{number}")

    writer = stream_documents(spark, folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(process)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
