"""Reading documents and annotations; nothing is inferred, bad files are set apart."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_SUFFIXES, PDF_SUFFIX = ("txt", "text"), "pdf"
ANNOTATIONS = """_contract_file STRING, _audited BOOLEAN, _audit_date STRING,
parties ARRAY<STRUCT<name:STRING,role:STRING,is_reader:BOOLEAN>>, effective_date STRING, term STRING, termination_notice_period STRING,
auto_renewal STRUCT<`exists`:BOOLEAN,period:STRING,notice_to_cancel:STRING>,
obligations ARRAY<STRUCT<id:STRING,party:STRING,type:STRING,description:STRING,deadline:STRING,conditions:STRING,source_text:STRING,source_location:STRING,_audit_status:STRING,_audit_notes:STRING>>,
risk_flags ARRAY<STRUCT<obligation_id:STRING,category:STRING,severity:STRING,title:STRING,description:STRING,source_text:STRING,source_location:STRING,_audit_status:STRING,_audit_notes:STRING>>,
key_definitions ARRAY<STRUCT<term:STRING,definition:STRING,source_location:STRING>>"""


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, suffix, stem) of the folder's own files, or of one file. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return with_stem(files.select("path"))


def with_stem(files: DataFrame) -> DataFrame:
    return files.withColumns({"suffix": F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)), "stem": F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)})


def decode_text(content: Column) -> Column:
    """UTF-8 where it is valid (a BOM stays), else Latin-1, which always is; line ends of
    any kind become line feeds."""
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1")), "\r\n?", "\n")


def _contents(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """The files of some kinds with their contents, whatever the case of their endings; no
    other file is opened."""
    either = lambda s: "".join(f"[{c}{c.upper()}]" for c in s)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(map(either, suffixes)) + "}").option("recursiveFileLookup", "false").load(folder)
    return with_stem(files.select("path", "content"))


def unsupported_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem, error) of the files of no known kind, which are listed and not opened."""
    rows = list_files(spark, folder).where(~F.col("suffix").isin(*TEXT_SUFFIXES, PDF_SUFFIX))
    ending = F.regexp_extract("path", r"(\.[^./]+)?$", 1)
    return rows.select("path", "stem", F.concat(F.lit("Unsupported file type: "), ending).alias("error"))


def read_documents(spark: SparkSession, folder: str, pdf_pages: Callable[[bytes], list[str]] | None = None, strict: bool = False, unsupported: bool = True) -> DataFrame:
    """(path, stem, raw_text, pages, error): one row a file; a file that cannot be read has
    an error and no text, or stops the job if ``strict``. Files of no known kind have an
    error too, unless ``unsupported`` is false. ``pages`` has the pages of a PDF. Files of
    no bytes at all have no row: Spark's listing passes over them."""
    none = lambda kind: F.lit(None).cast(kind)
    text = _contents(spark, folder, TEXT_SUFFIXES).select("path", "stem", decode_text(F.col("content")).alias("raw_text"), none("array<string>").alias("pages"), none("string").alias("error"))
    out = text.unionByName(read_pdf(_contents(spark, folder, (PDF_SUFFIX,)), pdf_pages))
    if unsupported:
        out = out.unionByName(unsupported_files(spark, folder).select("path", "stem", none("string").alias("raw_text"), none("array<string>").alias("pages"), "error"))
    if strict:
        out = out.withColumn("raw_text", F.when(F.col("error").isNotNull(), F.raise_error(F.concat("path", F.lit(": "), "error"))).otherwise(F.col("raw_text")))
    return out


def read_pdf(files: DataFrame, pdf_pages: Callable[[bytes], list[str]] | None, markers: bool = True) -> DataFrame:
    """Pages by an injected parser, each after its marker; without markers, pages with text alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, listed, errors = [], [], []
            for content in f["content"]:
                try:
                    if pdf_pages is None:
                        raise ValueError("no PDF parser given")
                    pages = [p or "" for p in pdf_pages(bytes(content))]
                    if not pages:
                        raise ValueError("no text")
                    texts.append("\n\n".join(f"[Page {i}]\n{p}" for i, p in enumerate(pages, 1)) if markers else "\n\n".join(p for p in pages if p))
                    listed.append(pages)
                    errors.append(None)
                except Exception as e:  # a bad file must not fail the others
                    texts.append(None)
                    listed.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"path": f["path"], "stem": f["stem"], "raw_text": texts, "pages": listed, "error": errors})

    return files.select("path", "stem", "content").mapInPandas(run, "path string, stem string, raw_text string, pages array<string>, error string")


def require_supported(path: str) -> str:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in (*TEXT_SUFFIXES, PDF_SUFFIX):
        raise ValueError(f"Unsupported file type: .{suffix}")
    return suffix


def read_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, raw, the fields of ANNOTATIONS): annotation files with the stem of their
    document; malformed JSON stops the job. ``raw`` is the file as it is, so that fields
    the schema does not name survive a rewrite."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_ground_truth.json").load(folder)
    raw = files.select(F.regexp_extract("path", r"([^/]+)_ground_truth\.json$", 1).alias("stem"), decode_text(F.col("content")).alias("raw"))
    parsed = raw.withColumn("a", F.from_json("raw", ANNOTATIONS, {"mode": "FAILFAST"}))
    return parsed.select("stem", "raw", "a.*")


#: Audit fields and what they start as; fixed values.
AUDIT_FIELDS = {"_audited": False, "_audit_date": None, "_audit_notes": "", "_missed_obligations": [], "_false_positives": []}
ITEM_FIELDS = {"_audit_status": "pending", "_audit_notes": ""}


@F.pandas_udf(T.StringType())
def prepared_json(raw: pd.Series) -> pd.Series:
    """Annotation files with the audit fields added where they are absent; everything that
    is there stays as it is."""

    def ready(text: str | None) -> str | None:
        if text is None:
            return None
        data = json.loads(text)
        for item in [x for name in ("obligations", "risk_flags") for x in data.get(name) or []]:
            item |= {k: v for k, v in ITEM_FIELDS.items() if k not in item}
        return json.dumps(data | {k: v for k, v in AUDIT_FIELDS.items() if k not in data}, indent=2, ensure_ascii=False)

    return raw.map(ready)


def with_annotations(docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """Documents left-joined to their annotations; of a text and a PDF the text is taken."""
    one = docs.groupBy("stem").agg(F.min_by(F.struct("path", "raw_text", "pages", "error"), F.when(F.lower("path").endswith(".pdf"), 1).otherwise(0)).alias("d"))
    return one.select("stem", "d.*").join(annotations, "stem", "left")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
