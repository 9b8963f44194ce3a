"""Agreements made from the order tables, by the same SQL in Spark and in DuckDB.

Every order is an agreement, every line of it a clause, whose wording its keys choose;
no random numbers, so both engines see the same texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Clause texts; {d} and {m} are day and month counts.
TEXTS = [
    "'Customer shall pay all invoices within {d} days; a penalty of 12 % applies after that.'",
    "'Either party shall give notice at least {d} days prior to the end of the term.'",
    "'This agreement will automatically renew for {m} months unless notice is given.'",
    "'Supplier may modify the fees at any time without notice in its sole discretion.'",
    "'Employee agrees not to compete anywhere for {m} months after the end of employment.'",
    "'Supplier must use commercially reasonable efforts and respond promptly to requests.'",
    "'Supplier shall respond promptly 5 times a day and materially breach nothing.'",
    "'No assignment without prior written consent, which shall not be unreasonably withheld.'",
    "'Disputes are settled by binding arbitration; the parties waive the right to a jury trial.'",
    "'Tenant must indemnify the landlord; liability is unlimited liability for all claims.'",
    "'Either party may terminate this agreement for any reason with {d} days of notice.'",
    "'Goods are delivered to the place named in the order. They are inspected on arrival.'",
    "'Customer covenants to keep trade secret information confidential in perpetual secrecy.'",
    "'The deposit equals three months of rent; forfeiture of the deposit follows late payment.'",
    "'Claims are brought within one year; exclusive jurisdiction lies with the court named.'",
    "'Supplier will not reuse the data, and is required to delete material copies as needed.'",
    "'On breach the party has to cure within {d} days, to the satisfaction of the other.'",
    "'Guarantor personally guarantees all sums without any limit; partners are jointly and severally bound and owe liquidated damages.'",
    "'Supplier shall indemnify the customer against any and all losses; retroactive charges and an evergreen term apply.'",
    "'Customer shall give notice at least 20 days before expiry; supplier may in its discretion terminate the order.'",
    "'Supplier may increase the price of goods at any time; fees are non-refundable and the stock must be adequate.'",
    "'Employee signs a non-compete and a non-solicit clause, shall not solicit staff and grants exclusive rights for 18 months.'",
    "'Contractor shall assign to the customer all inventions made as work for hire and use best efforts.'",
    "'Landlord may withhold consent in its sole and absolute discretion and may enter without approval.'",
    "'Customer accepts a class action waiver; the prevailing party recovers legal fees if it moves within 6 months to file.'",
    "'Tenant may remedy a lapse at its own cost, forfeits no payment and reserves the right to amend the plan without notice.'",
]
HEADINGS = ["'PAYMENT TERMS'", "'TERM AND NOTICE'", "'GENERAL'", "'RESTRICTIONS ON USE'"]


#: Lines of an order, numbered anew: their own numbers are not unique.
NUMBERED = """
SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS n
FROM lineitem"""


def _case(options: list[str], by: str) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(options)) + " END"


def _text(t: str) -> str:
    parts = t.strip("'").replace("{d}", "', l_partkey % 70 + 1, '").replace("{m}", "', (l_suppkey % 4 + 1) * 6, '")
    return f"concat('{parts}')"


CLAUSES = f"""
SELECT l_orderkey AS doc_id, n AS ord, concat('OBL-00', n) AS id,
  {_case(["'Customer'", "'Supplier'", "'Tenant'"], "l_suppkey % 3")} AS party,
  {_case(["'payment'", "'deadline'", "'restriction'", "'requirement'"], "l_partkey % 4")} AS type,
  concat('Duty ', n, ' of agreement ', l_orderkey) AS description,
  CASE WHEN l_partkey % 5 = 0 THEN 'if requested from time to time' END AS conditions,
  {_case([_text(t) for t in TEXTS], f"(l_orderkey * 7 + l_partkey + n) % {len(TEXTS)}")} AS source_text,
  CASE WHEN n % 2 = 0 THEN concat('Section ', n) END AS source_location,
  concat(n, '. ', {_case(HEADINGS, "l_suppkey % 4")}) AS heading
FROM numbered"""

QUOTES = """
SELECT doc_id, ord, id AS obligation_id, source_location,
  CASE (doc_id + ord) % 6 WHEN 2 THEN upper(source_text) WHEN 3 THEN replace(source_text, ' ', '  ')
    WHEN 4 THEN concat('Nothing of the kind stands in number ', ord, ' of this agreement.') WHEN 5 THEN ' ' ELSE source_text END AS source_text
FROM clauses"""

RENEWALS = """
SELECT o_orderkey AS doc_id, o_orderkey % 3 = 0 AS renews,
  CASE WHEN o_custkey % 4 > 0 THEN concat(o_custkey % 36 + 1, ' months') END AS period,
  CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'thirty (30) days' WHEN 2 THEN 'one month' ELSE concat(o_custkey % 60 + 1, ' business days') END AS notice
FROM orders"""

RESPONSES = """
SELECT l_orderkey AS doc_id, n - 1 AS chunk_index,
  CASE WHEN (l_orderkey + n) % 11 = 0 THEN concat('no JSON here ', l_partkey)
  ELSE concat(CASE WHEN l_partkey % 3 = 0 THEN 'Result: ```json ' ELSE '' END,
    '{"parties":[{"name":"Party ', l_suppkey % 3, '","role":"role ', n, '"}],"term":',
    CASE WHEN l_partkey % 4 = 0 THEN 'null' WHEN l_partkey % 4 = 1 THEN '""' ELSE concat('"', l_partkey % 9, ' years"') END,
    ',"obligations":[{"party":"Party ', l_suppkey % 3, '","description":"first ', n, '"},{"description":"second ', n, '"}],',
    '"key_definitions":[{"term":"', CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE concat('Term ', l_suppkey % 5) END, '","definition":"meaning ', n, '"}],',
    '"extraction_notes":"', CASE WHEN l_partkey % 2 = 0 THEN concat('note ', n) ELSE '' END, '"}',
    CASE WHEN l_partkey % 3 = 0 THEN ' ``` done' ELSE '' END) END AS response
FROM numbered"""

RAW = "concat(heading, chr(10), source_text)"
DOCS_SPARK = f"""
SELECT doc_id, concat('AGREEMENT', chr(10), chr(10), array_join(transform(array_sort(collect_list(struct(ord, {RAW} AS t))), x -> x.t), concat(chr(10), chr(10)))) AS raw_text
FROM clauses GROUP BY doc_id"""
DOCS_DUCK = f"""
SELECT doc_id, concat('AGREEMENT', chr(10), chr(10), string_agg({RAW}, concat(chr(10), chr(10)) ORDER BY ord)) AS raw_text
FROM clauses GROUP BY doc_id"""

DUCK = {"numbered": NUMBERED, "clauses": CLAUSES, "quotes": QUOTES, "renewals": RENEWALS, "responses": RESPONSES, "docs": DOCS_DUCK}


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """clauses, quotes, renewals, responses and docs over the tables of a folder.

    Clauses come sorted by document from their numbering, so they are grouped as they stand;
    a hash map of lists would be given up after some groups and all sorted once more. The
    setting stays in the session."""
    spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders")}
    out: dict[str, DataFrame] = {}
    for name, sql in (("numbered", NUMBERED), ("clauses", CLAUSES), ("renewals", RENEWALS), ("responses", RESPONSES), ("quotes", QUOTES), ("docs", DOCS_SPARK)):
        source = sql.split("FROM ")[1].split()[0]
        df = t.get(source, out.get(source))
        name_of = f"pactlens_{source}_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name_of)
        out[name] = spark.sql(sql.replace(f"FROM {source}", f"FROM {name_of}"))
        spark.catalog.dropTempView(name_of)
    return out


def duck(body: str) -> str:
    """SQL for DuckDB: the views that ``body`` needs, then ``body``."""
    need, text = [], body
    for name in reversed(list(DUCK)):
        if name in text:
            need.insert(0, name)
            text += DUCK[name]
    order = [n for n in DUCK if n in need]
    return "WITH " + ", ".join(f"{n} AS ({DUCK[n]})" for n in order) + (", " + body.strip()[5:] if body.strip().startswith("WITH ") else " " + body)
