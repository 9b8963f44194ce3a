"""Entry points by path: a document or a folder in, DataFrames out.

Each reads the documents and runs the whole plan lazily up to what it returns; nothing is
written unless ``store`` names a folder, which a paid or slow extractor should be given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import extract, report, risk, structure, verify
from .plans.analysis import analyse, documents
from .sources.readers import read_documents


def read(spark: SparkSession, path: str, pdf_pages=None) -> DataFrame:
    """(doc_id, raw_text, pages) of what can be read."""
    return documents(read_documents(spark, path, pdf_pages, unsupported=False))


def chunks(spark: SparkSession, path: str, chunk_size: int = structure.CHUNK_SIZE, overlap: int = structure.OVERLAP, pdf_pages=None) -> DataFrame:
    return structure.chunk_documents(read(spark, path, pdf_pages), chunk_size, overlap)


def analysis(spark: SparkSession, path: str, extractor=None, store: str | None = None, pdf_pages=None, rules: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every stage by name; ``errors`` has the documents that failed."""
    return analyse(read(spark, path, pdf_pages), extractor, store, rules=rules)


def extraction(spark: SparkSession, path: str, extractor=None, store: str | None = None, pdf_pages=None) -> DataFrame:
    """(doc_id, json): what was extracted of each document."""
    got = analysis(spark, path, extractor, store, pdf_pages)
    return extract.to_json(got["header"], got["parties"], got["obligations"], got["definitions"])


def verification(spark: SparkSession, path: str, extractor=None, store: str | None = None, fuzzy: float = verify.FUZZY, partial: float = verify.PARTIAL) -> tuple[DataFrame, DataFrame]:
    """(results, report) of the quotes of each document."""
    docs = read(spark, path)
    return verify_obligations(analyse(docs, extractor, store)["obligations"], docs, fuzzy, partial)


def verify_obligations(obligations: DataFrame, docs: DataFrame, fuzzy: float = verify.FUZZY, partial: float = verify.PARTIAL) -> tuple[DataFrame, DataFrame]:
    """(results, report) of obligations (doc_id, ord, id, source_text, source_location)."""
    quotes = obligations.withColumnRenamed("id", "obligation_id").select("doc_id", "ord", "obligation_id", "source_text", "source_location")
    results = verify.verify(quotes, docs, fuzzy, partial)
    return results, verify.verification_report(results)


def risks(spark: SparkSession, path: str, extractor=None, store: str | None = None, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(flags, summary) of each document."""
    got = analysis(spark, path, extractor, store, rules=rules)
    return got["flags"], risk.risk_summary(got["flags"])


def reports(spark: SparkSession, path: str, extractor=None, store: str | None = None) -> DataFrame:
    """(doc_id, json): the report of each document."""
    return report.report_json(analysis(spark, path, extractor, store)["report"])
