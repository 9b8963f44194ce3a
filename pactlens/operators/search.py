"""Work on items beside their document, with each document sent once.

A join gives every item a copy of its document; where the item then has to move on to a
Python worker, all copies travel. Here documents and items are one stream instead: hashed
by document and sorted, so that a document comes before its items, and a task keeps the one
document it is at. A document with very many items is sent once for each ``A_COPY`` of
them, to as many tasks. What is shuffled is the documents that have items, each twice, and
the items: it does not grow with items times length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Items that share one copy of their document.
A_COPY = 256
#: Items that are answered together.
TOGETHER = 1024


def beside_documents(items: DataFrame, docs: DataFrame, open_document: Callable[[object], Callable[[dict], tuple]], result: str, text: str = "raw_text", order: str = "ord", together: Callable[[list[tuple[object, dict]]], list[tuple]] | None = None) -> DataFrame:
    """``items`` (doc_id, .., in any order) with the columns of ``result``, a DDL string.

    ``open_document`` is called once for a document, with its column ``text`` (None if there
    is no document), and gives a function from an item, as a dict, to the values of
    ``result``. With ``together`` it may give anything: that answers TOGETHER items at once,
    each beside its opened document.
    """
    together = together or (lambda asked: [answer(item) for answer, item in asked])
    cols = [c for c in items.columns if c != "doc_id"]
    added = T._parse_datatype_string(result)
    copies = items.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / A_COPY).cast("int").alias("copies"))
    item = F.struct(*[F.col(f"`{c}`") for c in cols])
    kind = items.select(item.alias("item")).schema["item"].dataType
    none = F.lit(None).cast(kind)
    asked = items.join(copies, "doc_id").select("doc_id", F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in cols]), F.col("copies")).cast("int").alias("copy"), F.lit(None).cast(docs.schema[text].dataType).alias("text"), item.alias("item"))
    told = docs.join(copies, "doc_id").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col(text).alias("text"), none.alias("item"))
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as the work is in seconds, not in bytes
    stream = told.unionByName(asked).repartition(tasks, "doc_id", "copy").sortWithinPartitions("doc_id", "copy", F.col("item").isNotNull(), F.col(f"item.{order}"))
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, answer = None, None
        for b in batches:
            rows, asked, out = [], [], []
            for k, (doc, copy, there, of) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).is_null().to_pylist(), b.column(3))):
                if there:
                    at, answer = (doc, copy), open_document(b.column(2)[k].as_py())
                    continue
                if at != (doc, copy):
                    at, answer = (doc, copy), open_document(None)
                rows.append(k)
                asked.append((answer, of.as_py()))
                if len(asked) == TOGETHER:
                    out += together(asked)
                    asked = []
            out += together(asked)
            kept = b.take(pa.array(rows, pa.int64()))
            values = list(zip(*out)) if out else [()] * len(fields)
            columns = [kept.column(0), *kept.column(3).flatten(), *[pa.array(list(v), f.type) for v, f in zip(values, fields)]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *cols, *[f.name for f in fields]])

    schema = T.StructType([items.schema["doc_id"], *[T.StructField(f.name, f.dataType) for f in kind.fields], *added.fields])
    return stream.mapInArrow(run, schema)
