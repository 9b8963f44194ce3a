"""How far the word use of each source is from that of the others of its language.

Each task counts the terms of its documents by (lang, source) in bounded tables and sends
one row for each (lang, source, term) it met. Rows are hashed into shards by lang and
term, so a shard has all counts of its terms, a frequent language is dealt over all shards,
and a frequent term is a few rows a task. In each shard DuckDB sums the counts and keeps
the terms of enough documents; Spark adds the totals of each group and language. A second
pass over the shards has DuckDB value every term and add up, for each pair of sources that
share terms, what these terms contribute; Spark merges the partial sums and ranks.

A pair's value is a sum over all kept terms, those in neither source included, and is
taken without making these rows. With f(p, q) the value of a term, p0 and q0 the shares of
a term that does not occur, it is V f(p0, q0), plus f(p, q0) - f(p0, q0) for each term of
the one source, plus f(p0, q) - f(p0, q0) for each term of the other, plus
f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) for each term of both. The first three depend on
counts alone: each source's terms are summed up as (count, how many terms have it). Only
the last needs rows of two sources side by side.

All numbers are whole; sums are kept in 38 decimal digits.

Edges: null text, lang and source are ''. A group without terms still has a row for each
other source; without kept terms in its language every value is 0. The text of equal rows
counts as often as it occurs. Ties go by the item's UTF-8 bytes. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_work_table, small_batches, work_table

SCALE, LEAST_DOCS, TOP = 1_000_000_000, 3, 200
#: Bytes that part terms become blanks, capitals become small.
TERM_BYTES = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Terms that a task counts before it sends them on: about 150 MB.
HELD = 500_000
#: A task's dictionary packs two numbers: occurrences in the low bits, documents above.
DOC = 1 << 44
#: What DuckDB may take of a task's memory; beyond it, it spills.
SHARD_MEMORY = "400MB"
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, made small, and of all other characters from U+0080 on."""
    return text.translate(TERM_BYTES).split()


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (lang, source, text) to COUNTED; a row with the term '' names a group."""
    groups: dict[tuple[str, str], dict[bytes, int]] = {}
    seen: set[tuple[str, str]] = set()
    held = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in groups.items():
            n = len(found)
            values = list(found.values())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(found), pa.string()), pa.array([v & (DOC - 1) for v in values], pa.int64()), pa.array([v // DOC for v in values], pa.int64())], schema=COUNTED)
        groups.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            group = lang, source
            if group not in seen:
                seen.add(group)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((lang, source, "", 0, 0), COUNTED)], schema=COUNTED)
            found = groups.setdefault(group, {})
            before, get = len(found), found.get
            for term, n in Counter(terms(text.as_buffer().to_pybytes())).items():
                found[term] = get(term, 0) + n + DOC
            held += len(found) - before
            if held >= HELD:
                yield from sent()
                held = 0
    yield from sent()


def in_duckdb(schema: pa.Schema, steps: list[str]):
    """A function for mapInArrow: a partition's batches stream into DuckDB as table
    ``part``; the last of ``steps`` gives the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": SHARD_MEMORY, "temp_directory": spill}) as db:
            reader = pa.RecordBatchReader.from_batches(schema, (b.cast(schema) if b.schema != schema else b for b in batches))
            db.register("part", reader)
            for step in steps[:-1]:
                db.execute(step)
            yield from db.sql(steps[-1]).to_arrow_reader(1 << 14)

    return run


def kept_counts(docs: DataFrame, lang: str, source: str, text: str, least_docs: int) -> DataFrame:
    """(lang, source, term, n, leads): counts of the terms that at least ``least_docs``
    documents of their language have, ``leads`` true for one row of each (lang, term); and
    a row with the term '' for each group."""
    small_batches(docs.sparkSession)
    word = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    counted = docs.select(word(lang).alias("lang"), word(source).alias("source"), word(text).alias("text")).mapInArrow(count_terms, "lang string, source string, term string, n bigint, docs bigint")
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = in_duckdb(COUNTED, [
        "CREATE TEMP TABLE counted AS SELECT lang, term, source, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM part GROUP BY ALL",
        f"""SELECT lang, source, term, n, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AND term <> '' AS leads
        FROM counted SEMI JOIN (SELECT lang, term FROM counted GROUP BY ALL HAVING term = '' OR sum(docs) >= {int(least_docs)}) AS kept USING (lang, term)""",
    ])
    return counted.repartition(shards, "lang", "term").mapInArrow(run, "lang string, source string, term string, n bigint, leads boolean")


VALUED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("lang_total", pa.int64()), ("kept", pa.int64())])
PARTIAL = "part string, lang string, source string, item string, n bigint, value decimal(38,0)"


def _value(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) // ({q}))"


def _share(n: str, total: str) -> str:
    return f"(1 + {SCALE}::HUGEINT * ({n} + 1) // ({total} + kept))::BIGINT"


def valued_steps(top: int) -> list[str]:
    """One shard's terms, the highest of each group; its pairs of sources, summed; and how
    many terms of each group have which count."""
    both = lambda p, q, p0, q0: f"sum({_value(p, q)}::HUGEINT - {_value(p, q0)} - {_value(p0, q)} + {_value(p0, q0)})::DECIMAL(38, 0)"
    return [
        f"""CREATE TEMP TABLE r AS SELECT lang, term, source, n, {_share("n", "total")} AS p, {_share("0", "total")} AS p0,
        {_share("sum(n) OVER (PARTITION BY lang, term)", "lang_total")} AS q FROM part""",
        "CREATE TEMP TABLE pairs AS SELECT a.lang, a.source AS s, b.source AS t, "
        + both("a.p", "b.p", "a.p0", "b.p0") + " AS st, " + both("b.p", "a.p", "b.p0", "a.p0") + " AS ts FROM r AS a JOIN r AS b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL",
        f"""SELECT 'term' AS part, lang, source, term AS item, n, {_value("p", "q")}::DECIMAL(38, 0) AS value FROM r WHERE p > q
        QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {_value("p", "q")} DESC, term) <= {int(top)}
        UNION ALL SELECT 'both', lang, s, t, NULL, st FROM pairs UNION ALL SELECT 'both', lang, t, s, NULL, ts FROM pairs
        UNION ALL SELECT 'count', lang, source, NULL, n, count(*)::DECIMAL(38, 0) FROM r GROUP BY lang, source, n""",
    ]


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (n + 1) / (total + kept)); 1 where the language keeps no term."""
    return F.coalesce(F.lit(1) + F.call_function("div", (n.cast("decimal(20,0)") + 1) * F.lit(SCALE).cast("decimal(10,0)"), F.nullif(total + kept, F.lit(0)).cast("decimal(20,0)")), F.lit(1).cast("bigint"))


def value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of
    the language by divergence, part ``term`` the ``top`` terms that the source has more
    often than its language."""
    spark = docs.sparkSession
    kept = work_table(kept_counts(docs, lang, source, text, least_docs), "divergence-counts")
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("leads").alias("kept"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = work_table(of_group.join(of_lang, "lang"), "divergence-groups")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = kept.where("term <> ''").join(groups, ["lang", "source"]).select(*VALUED.names).repartition(shards, "lang", "term")
    partial = work_table(rows.mapInArrow(in_duckdb(VALUED, valued_steps(top)), PARTIAL), "divergence-partial")
    drop_work_table(kept)

    a = groups.select("lang", "source", "total", "kept", share(F.lit(0), F.col("total"), F.col("kept")).alias("p0"))
    b = groups.select("lang", F.col("source").alias("item"), share(F.lit(0), F.col("total"), F.col("kept")).alias("q0"))
    mine = partial.where("part = 'count'").groupBy("lang", "source", "n").agg(F.sum("value").cast("bigint").alias("terms")).join(a, ["lang", "source"])
    mine = mine.select("lang", "source", "terms", "p0", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    other = b.join(mine, "lang").where("source <> item")
    flat = value(F.col("p0"), F.col("q0"))
    there = value(F.col("q0"), F.col("p0"))
    wide = lambda n, x: n.cast("decimal(18,0)") * x.cast("decimal(19,0)")
    summed = lambda df, s, t, x: df.groupBy("lang", F.col(s).alias("source"), F.col(t).alias("item")).agg(F.sum(x).cast("decimal(38,0)").alias("value"))
    parts = summed(other, "source", "item", wide(F.col("terms"), value(F.col("p"), F.col("q0")) - flat))
    parts = parts.unionByName(summed(other, "item", "source", wide(F.col("terms"), value(F.col("q0"), F.col("p")) - there)))
    parts = parts.unionByName(a.join(b, "lang").where("source <> item").select("lang", "source", "item", wide(F.col("kept"), flat).cast("decimal(38,0)").alias("value")))
    parts = parts.unionByName(partial.where("part = 'both'").select("lang", "source", "item", "value"))
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("bigint").alias("value"))
    high = partial.where("part = 'term'").select("lang", "source", "item", F.col("value").cast("bigint").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(high, "term").where(F.col("rank") <= top))
