"""Structured records from chunks by an injected extractor, and their merge by document."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound

RESPONSE = """parties ARRAY<STRUCT<name:STRING,role:STRING,is_reader:BOOLEAN>>, effective_date STRING, term STRING,
termination_notice_period STRING, auto_renewal STRUCT<`exists`:BOOLEAN,period:STRING,notice_to_cancel:STRING>,
obligations ARRAY<STRUCT<id:STRING,party:STRING,type:STRING,description:STRING,deadline:STRING,conditions:STRING,source_text:STRING,source_location:STRING>>,
key_definitions ARRAY<STRUCT<term:STRING,definition:STRING,source_location:STRING>>, extraction_notes STRING, _corrupt_record STRING"""


#: What stands between the place of a chunk and its text in a message; a fixed value.
TEXT_MARK = "CONTRACT TEXT:\n\n"


class RuleExtractor:
    """A deterministic extractor that needs no network: a sentence with an obligation
    keyword is an obligation. Any ``extractor(text) -> JSON`` may take its place."""

    def __call__(self, text: str) -> str:
        from .audit import KEYWORDS

        found = []
        for sentence in re.split(r"(?<=[.;])\s+", text.split(TEXT_MARK, 1)[-1]):
            if len(sentence.strip()) >= 10 and any(re.search(p, sentence, re.I) for p in KEYWORDS.values()):
                found.append({"party": "Unknown", "type": "requirement", "description": sentence.strip(), "source_text": sentence.strip()})
        return json.dumps({"obligations": found})


class RemoteExtractor:
    """Wraps a client that needs a key; without one it cannot be made."""

    def __init__(self, call: Callable[[str, str], str], api_key: str | None, prompt: str):
        if not api_key:
            raise ValueError("API key required")
        self.call, self.prompt = call, prompt

    def __call__(self, text: str) -> str:
        return self.call(self.prompt, text)


def read_prompt(path: str) -> str:
    """A prompt file, read once on the driver; FileNotFoundError if it is absent."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def chunk_message() -> Column:
    """What the extractor is asked: the chunk, with its place if there are several."""
    place = F.format_string("[This is chunk %d of %d from the contract. Source: %s]\n\n", F.col("chunk_index") + 1, "total_chunks", "source_location")
    return F.concat(F.when(F.col("total_chunks") > 1, place).otherwise(F.lit("")), F.lit(TEXT_MARK), "text")


#: Calls of the extractor for a chunk, before it counts as failed.
ATTEMPTS = 3


def _ask(call: Callable[[str], str], message: str, attempts: int, pause: float) -> tuple[str | None, int, str | None]:
    """(answer, calls, None), or (None, calls, what was raised last)."""
    error = None
    for k in range(1, attempts + 1):
        try:
            return call(message), k, None
        except Exception as e:  # a chunk that fails must not fail the others
            error = f"{type(e).__name__}: {e}"
            if k < attempts:
                time.sleep(pause * 2 ** (k - 1))
    return None, attempts, error


def extract(chunks: DataFrame, extractor: Callable[[str], str] | None = None, attempts: int = ATTEMPTS, pause: float = 0.0) -> DataFrame:
    """(doc_id, chunk_index, response, attempts, failure): the extractor's raw answer for
    each chunk. A call that raises is repeated, after ``pause`` seconds and then twice as
    long each time; where all ``attempts`` raise there is no answer, and ``failure`` says
    what was raised. Its answers may differ each time: store them before using them twice."""
    call = extractor or RuleExtractor()
    if attempts < 1:
        raise ValueError("at least one attempt is needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_ask(call, m, attempts, pause) for m in b.column(2).to_pylist()]
            response, calls, failure = (list(c) for c in zip(*got)) if got else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(response, pa.string()), pa.array(calls, pa.int32()), pa.array(failure, pa.string())], names=["doc_id", "chunk_index", "response", "attempts", "failure"])

    kind = chunks.schema["doc_id"].dataType.simpleString()
    asked = chunks.select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"), chunk_message().alias("message"))
    return asked.mapInArrow(run, f"doc_id {kind}, chunk_index int, response string, attempts int, failure string")


def failed_documents(responses: DataFrame) -> DataFrame:
    """(doc_id, failed_chunks, error): documents of which a chunk has no answer, with what
    the first such chunk raised. Half an analysis would pass for a whole one."""
    bad = responses.where("failure IS NOT NULL")
    return bad.groupBy("doc_id").agg(F.count(F.lit(1)).alias("failed_chunks"), F.min_by("failure", "chunk_index").alias("error"))


def whole_documents(responses: DataFrame) -> DataFrame:
    """The answers of the documents that have all of theirs."""
    return responses.join(responses.where("failure IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_anti")


def unfenced(response: Column) -> Column:
    """The body of the first fenced block, else the whole response."""
    body = F.regexp_extract(response, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    found = F.when(F.contains(response, F.lit("```")), body)
    return bound(found, lambda b: F.coalesce(F.when(b != "", b), response))


def parse(responses: DataFrame) -> DataFrame:
    """Parsed records; where the response is no JSON, ``error`` is set and lists are empty."""
    rows = responses.withColumn("r", F.from_json(unfenced(F.col("response")), RESPONSE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    names = ["parties", "effective_date", "term", "termination_notice_period", "auto_renewal", "obligations", "key_definitions"]
    return rows.select("doc_id", "chunk_index", bad.alias("error"), *[F.when(~bad, F.col(f"r.{c}")).alias(c) for c in names], F.when(bad, "JSON parsing error").otherwise(F.col("r.extraction_notes")).alias("notes"), F.when(bad, F.col("response")).alias("raw_response"))


def _each(parsed: DataFrame, name: str, as_: str) -> DataFrame:
    """(doc_id, chunk_index, pos, value) of a list's elements. An inner generator's filter
    would be pushed below the parsing, which would be done once more for it, or oftener."""
    rows = parsed.select("doc_id", "chunk_index", F.posexplode_outer(name).alias("pos", as_))
    return rows.where("pos IS NOT NULL")


def _first_of_each(rows: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy("doc_id", key).orderBy("chunk_index", "pos")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def merge_parties(parsed: DataFrame) -> DataFrame:
    """(doc_id, ord, name, role, is_reader): the first party of each name, in order."""
    rows = _each(parsed, "parties", "p")
    rows = rows.select("doc_id", "chunk_index", "pos", F.coalesce("p.name", F.lit("Unknown")).alias("name"), F.coalesce("p.role", F.lit("Unknown")).alias("role"), F.coalesce("p.is_reader", F.lit(False)).alias("is_reader"))
    return _numbered(_first_of_each(rows, "name")).drop("chunk_index", "pos")


def merge_definitions(parsed: DataFrame) -> DataFrame:
    """(doc_id, ord, term, definition, source_location): the first of each term, if not empty."""
    rows = _each(parsed, "key_definitions", "d").select("doc_id", "chunk_index", "pos", F.coalesce("d.term", F.lit("")).alias("term"), F.coalesce("d.definition", F.lit("")).alias("definition"), F.coalesce("d.source_location", F.lit("Unknown")).alias("source_location"))
    return _numbered(_first_of_each(rows.where("term <> ''"), "term")).drop("chunk_index", "pos")


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "pos")))


def merge_obligations(parsed: DataFrame) -> DataFrame:
    """Obligations numbered anew over all chunks; none is dropped."""
    rows = _numbered(_each(parsed, "obligations", "o"))
    default = {"party": "Unknown", "type": "requirement", "description": "", "source_text": "", "source_location": "Unknown"}
    cols = [F.coalesce(f"o.{c}", F.lit(v)).alias(c) for c, v in default.items()]
    return rows.select("doc_id", "ord", F.format_string("OBL-%03d", "ord").alias("id"), *cols, "o.deadline", "o.conditions")


def merge_header(parsed: DataFrame) -> DataFrame:
    """(doc_id, effective_date, term, termination_notice_period, auto_renewal, notes,
    chunks_processed): first values that are not empty, notes in order."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("chunk_index"))).alias(c)
    renewal = F.min_by("auto_renewal", F.when(F.col("auto_renewal.exists"), F.col("chunk_index")))
    notes = F.array_sort(F.collect_list(F.when(F.coalesce("notes", F.lit("")) != "", F.struct("chunk_index", "notes"))))
    kind = "struct<exists: boolean, period: string, notice_to_cancel: string>"
    none = F.struct(F.lit(False), F.lit(None), F.lit(None)).cast(kind)
    out = parsed.groupBy("doc_id").agg(first("effective_date"), first("term"), first("termination_notice_period"), renewal.alias("r"), F.count_if(F.col("auto_renewal.exists")).alias("n"), notes.alias("s"), F.count(F.lit(1)).alias("chunks_processed"))
    for c in ("effective_date", "term", "termination_notice_period"):
        out = out.withColumn(c, F.nullif(c, F.lit("")))
    return out.select("doc_id", "effective_date", "term", "termination_notice_period", F.when(F.col("n") > 0, F.col("r").cast(kind)).otherwise(none).alias("auto_renewal"), F.array_join(F.transform("s", lambda x: x["notes"]), "\n").alias("notes"), "chunks_processed")


def to_json(header: DataFrame, parties: DataFrame, obligations: DataFrame, definitions: DataFrame) -> DataFrame:
    """(doc_id, json): one object for each document; the key names are fixed values."""
    rows = header
    for df, name, cols in ((parties, "parties", ["name", "role", "is_reader"]), (obligations, "obligations", ["id", "party", "type", "description", "deadline", "conditions", "source_text", "source_location"]), (definitions, "key_definitions", ["term", "definition", "source_location"])):
        items = F.array_sort(F.collect_list(F.struct("ord", F.struct(*cols).alias("row"))))
        rows = rows.join(df.groupBy("doc_id").agg(F.transform(items, lambda x: x["row"]).alias(name)), "doc_id", "left")
        rows = rows.withColumn(name, F.coalesce(name, F.from_json(F.lit("[]"), rows.schema[name].dataType)))
    fields = F.struct(F.col("doc_id").cast("string").alias("file_path"), "parties", "effective_date", "term", "termination_notice_period", "auto_renewal", "obligations", "key_definitions", F.col("notes").alias("extraction_notes"), "chunks_processed")
    return rows.select("doc_id", F.to_json(fields, {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))
