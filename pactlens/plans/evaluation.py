"""Evaluation of a folder of documents against their annotations, and a command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate
from ..session import session, stored
from ..sources.named_files import write_named
from ..sources.readers import read_annotations, read_documents, with_annotations, write_json
from .analysis import analyse
from .audit import items_of

AGGREGATE = ["Contracts evaluated: {}", "Average Obligation F1: {:.1%}", "Average Risk Flag F1:  {:.1%}"]


def evaluate_documents(rows: DataFrame, extractor=None, store: str | None = None, attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(reports, errors) of annotated documents (stem, raw_text, pages, the annotations):
    each is analysed and held against its annotations. A document whose analysis fails has
    an error and no report; one without annotations must not be among ``rows``."""
    docs = rows.select(F.col("stem").alias("doc_id"), "raw_text", "pages")
    got = analyse(docs, extractor, store, attempts)
    notes = rows.join(got["errors"].select(F.col("doc_id").alias("stem")), "stem", "left_anti")
    obligations = items_of(notes, "obligations").select("doc_id", F.col("ord").cast("int").alias("ord"), F.coalesce("id", F.concat(F.lit("GT-"), "ord")).alias("id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("party", "type", "description", "source_text")])
    risks = items_of(notes, "risk_flags").select("doc_id", F.col("ord").cast("int").alias("ord"), "set_ord", "category", "severity", *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "source_text")])
    parties = notes.select(F.col("stem").alias("doc_id"), F.explode("parties").alias("p")).select("doc_id", "p.name")
    header = notes.select(F.col("stem").alias("doc_id"), "effective_date", "term", "termination_notice_period", "auto_renewal")
    out = evaluate.evaluation_report((got["obligations"], obligations), (got["flags"], risks), (got["parties"], parties), (got["header"], header))
    return out, got["errors"]


def evaluate_folder(spark: SparkSession, documents: str, annotations: str, out: str, extractor=None, attempts: int = 3, pdf_pages=None) -> dict:
    """Evaluate every document of a folder (or one) that has annotations. Below ``out``:
    <name>_evaluation.json and <name>_evaluation.txt of each, ``_errors`` with the others,
    and the aggregate, which is returned: how many were evaluated, the means of their F1."""
    files = with_annotations(read_documents(spark, documents, pdf_pages, unsupported=False), read_annotations(spark, annotations))
    rows = files.where("raw IS NOT NULL AND error IS NULL")
    reports, failed = evaluate_documents(rows, extractor, f"{out}/_store", attempts)
    reports = stored(reports, f"{out}/_store/evaluation")
    named = lambda df, column, ending: df.select(F.concat("doc_id", F.lit(ending)).alias("name"), F.col(column).alias("content"))
    write_named(named(evaluate.evaluation_json(reports), "json", "_evaluation.json").unionByName(named(evaluate.evaluation_text(reports), "text", "_evaluation.txt")), out)
    absent = files.where("raw IS NULL OR error IS NOT NULL").select("stem", F.coalesce("error", F.lit("no annotations")).alias("error"))
    write_json(absent.unionByName(failed.select(F.col("doc_id").alias("stem"), "error")), f"{out}/_errors")
    means = reports.agg(F.count(F.lit(1)).alias("n"), F.avg("obligations.f1_score").alias("obligation_f1"), F.avg("risk_flags.f1_score").alias("risk_f1"), F.avg("overall_f1").alias("overall_f1")).first()
    return means.asDict()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("documents", help="a document, or a folder of which all with annotations are evaluated")
    p.add_argument("--annotations", required=True)
    p.add_argument("--output", "-o", default="evaluation")
    p.add_argument("--quiet", "-q", action="store_true", help="only print the aggregate")
    args = p.parse_args(argv)
    spark = session()
    found = evaluate_folder(spark, args.documents, args.annotations, args.output)
    if not args.quiet:  # a report for reading is a few lines; so many are shown at most
        for r in evaluate.evaluation_text(spark.read.parquet(f"{args.output}/_store/evaluation")).orderBy("doc_id").limit(100).collect():
            print(r["text"])
    if found["n"]:
        print("\n".join(AGGREGATE).format(found["n"], found["obligation_f1"], found["risk_f1"]))
    return int(not found["n"])


if __name__ == "__main__":
    sys.exit(main())
