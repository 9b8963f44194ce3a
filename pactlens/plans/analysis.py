"""The whole analysis of a folder of documents in one plan, and a small command line."""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, report, risk, structure, verify
from ..session import session, stored
from ..sources.readers import read_documents, write_json


def analyse(docs: DataFrame, extractor=None, store: str | None = None, attempts: int = extract.ATTEMPTS, rules: DataFrame | None = None) -> dict[str, DataFrame]:
    """All stages over ``docs`` (doc_id, raw_text and, if they came with their own, pages).

    What the extractor says is used by several stages, and it may be slow, paid for and
    say something else the next time: give the folder ``store``, and its raw answers are
    written there once and read back. Where a chunk has no answer after all attempts, its
    document is in ``errors`` and in no other result; the others go on.
    """
    chunks = structure.chunk_documents(docs)
    responses = stored(extract.extract(chunks, extractor, attempts), store and f"{store}/responses")
    errors, whole = extract.failed_documents(responses), extract.whole_documents(responses)
    parsed = extract.parse(whole)
    parties, obligations = extract.merge_parties(parsed), extract.merge_obligations(parsed)
    header, definitions = _headers(docs, errors, extract.merge_header(parsed)), extract.merge_definitions(parsed)
    quotes = obligations.select("doc_id", "ord", F.col("id").alias("obligation_id"), "source_text", "source_location")
    results = stored(verify.verify(quotes, docs, store=store and f"{store}/exact"), store and f"{store}/results")
    flags = risk.score_risks(obligations, header, rules)
    verification, summary = verify.verification_report(results), risk.risk_summary(flags)
    summaries = report.summary_text(header, parties, obligations, verification, summary)
    full = report.build_report(header, parties, definitions, obligations, flags, results, verification, summary, summaries)
    return {"chunks": chunks, "responses": responses, "errors": errors, "parties": parties, "obligations": obligations, "definitions": definitions, "header": header, "results": results, "flags": flags, "report": full}


def _headers(docs: DataFrame, errors: DataFrame, header: DataFrame) -> DataFrame:
    """A header for every document that did not fail: one without text has no chunks, and
    so no answers to merge."""
    rows = docs.select("doc_id").join(errors, "doc_id", "left_anti").join(header, "doc_id", "left")
    none = F.from_json(F.lit('{"exists": false}'), header.schema["auto_renewal"].dataType)
    return rows.withColumns({"auto_renewal": F.coalesce("auto_renewal", none), "notes": F.coalesce("notes", F.lit("")), "chunks_processed": F.coalesce("chunks_processed", F.lit(0))})


def documents(files: DataFrame) -> DataFrame:
    """What was read of files without an error, by path."""
    return files.where("error IS NULL").select(F.col("path").alias("doc_id"), "raw_text", "pages")


def analyse_folder(spark: SparkSession, folder: str, out: str, extractor=None, stages: bool = False, attempts: int = extract.ATTEMPTS, pdf_pages=None, whole_folder: bool = True) -> tuple[int, int]:
    """Write reports of the documents in a folder, or of one file; (reports, documents with
    an error). Of a folder, files of no known kind are listed among the errors and not
    counted; one such file is an error.

    A document's id is its path, so files of one name in two folders or with two endings
    stay apart. Below ``out``: <name>_analysis.json, <name>_summary.txt, <name>_report.md and,
    with ``stages``, <name>_extraction.json, _risks.json and _verification.json; ``_errors`` has a
    line for each file or document that failed, with its stage, and ``_store`` what later
    stages read back. Exact answers stay in ``_store``, so a failed chunk can be looked up.
    """
    files = read_documents(spark, folder, pdf_pages)
    done = analyse(documents(files), extractor, f"{out}/_store", attempts)
    full = stored(done["report"], f"{out}/_store/report")
    extracted = extract.to_json(done["header"], done["parties"], done["obligations"], done["definitions"]) if stages else None
    report.write_reports(full, out, save_markdown=True, results=done["results"] if stages else None, extracted=extracted)
    unread = files.where("error IS NOT NULL").select("path", F.when(F.col("error").startswith("Unsupported file type"), "unsupported").otherwise("read").alias("stage"), "error")
    failed = done["errors"].select(F.col("doc_id").alias("path"), F.lit("extract").alias("stage"), "error")
    errors = stored(unread.unionByName(failed), f"{out}/_store/errors")
    write_json(errors, f"{out}/_errors")
    counted = errors.where("stage <> 'unsupported'") if whole_folder else errors
    return full.count(), counted.count()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", "-i", required=True, help="a document or a folder of documents")
    p.add_argument("--output", "-o", default="results")
    p.add_argument("--stages", action="store_true", help="also write risks and verification")
    args = p.parse_args(argv)
    alone = bool(re.search(r"\.[^./]+$", args.input.rstrip("/"))) and not os.path.isdir(args.input)
    good, bad = analyse_folder(session(), args.input, args.output, stages=args.stages, whole_folder=not alone)
    print(f"Processed: {good + bad} files\n  Succeeded: {good}\n  Failed: {bad}")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
