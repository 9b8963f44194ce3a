"""Audit of a folder of annotations against its documents, and a small command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..session import session, stored
from ..sources.named_files import write_named
from ..sources.readers import prepared_json, read_annotations, read_documents, with_annotations


def items_of(rows: DataFrame, name: str) -> DataFrame:
    """(doc_id, ord, set_ord, the item's fields) of a list of annotations, in its order."""
    out = rows.select(F.col("stem").alias("doc_id"), F.posexplode(name).alias("place", "x"))
    return out.select("doc_id", (F.col("place") + 1).alias("ord"), F.lit(0).alias("set_ord"), "x.*")


def audit_folder(spark: SparkSession, folder: str, annotations: str, out: str, threshold: float = 0.85, prepare: bool = False) -> dict[str, int]:
    """Audit every document of a folder (or one) that has annotations; counts of items by
    status. Below ``out``: <name>_audit.md, <name>_console.txt and, to ``prepare``,
    <name>_ground_truth.json, which is the annotation file with the audit fields it lacked.

    The searched quotes are stored and read back, as three outputs need them.
    """
    notes = read_annotations(spark, annotations)
    rows = with_annotations(read_documents(spark, folder, unsupported=False).where("error IS NULL"), notes).where("raw IS NOT NULL")
    docs = rows.select(F.col("stem").alias("doc_id"), "raw_text")
    obligations, flags = items_of(rows, "obligations"), items_of(rows, "risk_flags")
    items = audit.audit_items(obligations, flags)
    said = obligations.select("doc_id", F.col("ord").cast("int").alias("ord"), F.lit("obligation").alias("item_type"), "description", F.lit("").alias("severity"))
    said = said.unionByName(flags.select("doc_id", F.col("ord").cast("int").alias("ord"), F.lit("risk_flag").alias("item_type"), F.coalesce("title", "description").alias("description"), "severity"))
    results = stored(audit.verify_quotes(items, docs, threshold, f"{out}/_store/exact").join(said, ["doc_id", "ord", "item_type"]), f"{out}/_store/results")
    misses = stored(audit.potential_misses(audit.keyword_sentences(docs), items), f"{out}/_store/misses")
    names = rows.select(F.col("stem").alias("doc_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    named = lambda df, column, ending: df.select(F.concat("doc_id", F.lit(ending)).alias("name"), F.col(column).alias("content"))
    files = named(audit.render_checklist(results, misses, names), "markdown", "_audit.md").unionByName(named(audit.console_lines(results, misses), "text", "_console.txt"))
    if prepare:
        files = files.unionByName(named(notes.select(F.col("stem").alias("doc_id"), prepared_json("raw").alias("json")), "json", "_ground_truth.json"))
    write_named(files, out)
    return {r["status"]: r["count"] for r in results.groupBy("status").count().collect()}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--documents", required=True)
    p.add_argument("--annotations", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--prepare", action="store_true")
    p.add_argument("--threshold", type=float, default=0.85)
    args = p.parse_args(argv)
    found = audit_folder(session(), args.documents, args.annotations, args.output, args.threshold, args.prepare)
    print(", ".join(f"{n} {status.lower()}" for status, n in sorted(found.items())) or "no items")
    return 0


if __name__ == "__main__":
    sys.exit(main())
