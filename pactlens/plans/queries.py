"""The engine's queries over the agreements of ``clauses``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_text
from ..operators import audit, evaluate, extract, report, risk, structure, verify
from ..session import stored, work_path
from .clauses import duck, views

Query = Callable[[SparkSession, str], DataFrame]


def _header(v: dict[str, DataFrame]) -> DataFrame:
    none = F.lit(None).cast("string")
    return v["renewals"].select("doc_id", none.alias("effective_date"), F.when(F.col("doc_id") % 2 == 0, "2 years").alias("term"), F.struct(F.col("renews").alias("exists"), "period", F.col("notice").alias("notice_to_cancel")).alias("auto_renewal"))


def _marked(v: dict[str, DataFrame]) -> DataFrame:
    """Documents with page markers, a page for each clause."""
    pages = F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("[Page "), "ord", F.lit("]\n"), "source_text").alias("t"))))
    return v["clauses"].groupBy("doc_id").agg(F.array_join(F.transform(pages, lambda x: x["t"]), "\n\n").alias("raw_text"))


def _results(v: dict[str, DataFrame]) -> DataFrame:
    """Verification without fuzzy search: what is not found is unverified."""
    rows = verify.exact_verify(v["quotes"], v["docs"])
    return verify.with_verdicts(rows.withColumns({"status": F.coalesce("status", F.lit("unverified")), "confidence": F.coalesce("confidence", F.lit(0.0))}))


def quote_exact(v):
    return _results(v).select("doc_id", "ord", "status", "confidence")


def quote_verify_rollup(v):
    return verify.verification_report(_results(v)).withColumn("rate", F.round("rate", 3))


def quote_key_phrases(v):
    docs = v["docs"].select("doc_id", F.lower("raw_text").alias("doc_lower"))
    rows = v["quotes"].withColumn("phrases", verify.key_phrases(F.col("source_text"))).join(docs, "doc_id")
    return rows.select("doc_id", "ord", F.size("phrases").alias("n_phrases"), verify.phrases_found(F.col("phrases"), F.col("doc_lower")).alias("n_found"))


def quote_original_sentence(v):
    docs = v["docs"].select("doc_id", verify.sentences(F.col("raw_text")).alias("sentences"))
    quotes = v["quotes"].where(F.trim("source_text") != "").select("doc_id", "ord", norm_text(F.col("source_text")).alias("quote_norm"))
    return quotes.join(docs, "doc_id").select("doc_id", "ord", verify.original_sentence(F.col("sentences"), F.col("quote_norm")).alias("sentence"))


def page_location(v):
    rows = v["clauses"].join(_marked(v), "doc_id")
    return rows.select("doc_id", "ord", verify.page_location(F.col("raw_text"), F.col("source_text"), F.col("source_location")).alias("location"))


def section_headers(v):
    return structure.sections(v["docs"].withColumn("page", F.lit(1)).withColumnRenamed("raw_text", "text"))


def paragraphs(v):
    return structure.paragraphs(v["docs"].select("doc_id", F.lit(1).alias("page"), F.col("raw_text").alias("text")))


def paragraph_sections(v):
    pages = v["docs"].select("doc_id", F.lit(1).alias("page"), F.col("raw_text").alias("text"))
    rows = structure.page_paragraphs(pages).where("text IS NOT NULL")
    return rows.select("doc_id", "ord", F.array_join("sections", "|").alias("sections"))


def paginate(v):
    return structure.paginate(v["docs"], 200)


def chunk_fold(v):
    return structure.chunk_documents(v["docs"], 400, 80).withColumn("sections", F.array_join("sections", "|"))


def keyword_sentences(v):
    return audit.keyword_sentences(v["docs"])


def keyword_top3(v):
    return audit.keyword_top(keyword_sentences(v)).select("doc_id", "keyword", "n", "of", "sentence")


def keyword_priority_top10(v):
    return audit.priority_top(keyword_sentences(v)).select("doc_id", "n", "keyword", "sentence")


def rule_match(v):
    return risk.rule_matches(v["clauses"]).groupBy("category", "rule").agg(F.count(F.lit(1)).alias("n"))


def rule_first_per_category(v):
    return risk.score_risks(v["clauses"]).select("doc_id", "ord", "category", "severity", "title", "description")


def obligation_risk_rollup(v):
    return risk.obligation_rollup(risk.score_risks(v["clauses"])).withColumn("risk_flags", F.array_join("risk_flags", "|"))


def auto_renewal_flag(v):
    return risk.renewal_flags(_header(v)).select("doc_id", "severity", "description")


def risk_summary(v):
    return risk.risk_summary(risk.score_risks(v["clauses"]))


def json_extract_tolerant(v):
    return extract.parse(v["responses"]).select("doc_id", "chunk_index", "error", "term", "notes")


def merge_parties(v):
    return extract.merge_parties(extract.parse(v["responses"])).select("doc_id", "ord", "name", "role")


def merge_metadata(v):
    return extract.merge_header(extract.parse(v["responses"])).select("doc_id", "term", "notes", "chunks_processed")


def renumber_obligations(v):
    return extract.merge_obligations(extract.parse(v["responses"])).select("doc_id", "id", "party", "type", "description", "source_location")


def merge_definitions(v):
    return extract.merge_definitions(extract.parse(v["responses"])).select("doc_id", "ord", "term", "definition", "source_location")


def report_join(v):
    rows = report.join_obligations(v["clauses"], risk.score_risks(v["clauses"]), _results(v))
    return rows.withColumn("risk_flags", F.array_join("risk_flags", "|"))


def review_queue(v):
    return report.review_queue(_results(v), risk.score_risks(v["clauses"])).drop("details")


def report_summary_text(v):
    parties = v["clauses"].groupBy("doc_id", F.col("party").alias("name")).agg(F.min("ord").alias("ord")).select("doc_id", "ord", "name", F.lit("party").alias("role"), (F.col("name") == "Tenant").alias("is_reader"))
    flags = risk.score_risks(v["clauses"])
    return report.summary_text(_header(v), parties, v["clauses"], verify.verification_report(_results(v)), risk.risk_summary(flags))


def _truth(v):
    return v["clauses"].where("(doc_id + ord) % 4 <> 0")


def eval_party_sets(v):
    out = evaluate.party_sets(v["clauses"].select("doc_id", F.col("party").alias("name")), _truth(v).select("doc_id", F.when(F.col("ord") % 3 == 0, F.concat("party", F.lit(" Ltd"))).otherwise(F.upper("party")).alias("name")))
    return out.select("doc_id", *[F.array_join(c, "|").alias(c) for c in ("matched", "extra", "missing")])


def _scores(v):
    t = _truth(v).select("doc_id", F.col("ord").alias("truth_ord"), F.col("type").alias("t_type"), F.col("party").alias("t_party"))
    same = F.when(F.col("party") == F.col("t_party"), 0.5).otherwise(0.0) + F.when(F.col("type") == F.col("t_type"), 0.375).otherwise(0.125)
    return v["clauses"].join(t, "doc_id").select("doc_id", "ord", "truth_ord", same.alias("score"))


def eval_greedy_match(v):
    return evaluate.match_by_score(_scores(v), 0.6)


def eval_prf1(v):
    m = v["clauses"].join(_truth(v).select("doc_id", "ord", F.col("ord").alias("truth_ord")), ["doc_id", "ord"], "left")
    out = evaluate.metrics(m.where("ord % 5 <> 0"), _truth(v))
    return out.select("doc_id", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def fuzzy_verify(v):
    store = work_path(v["docs"].sparkSession, "exact-quotes")
    return verify.verify(v["quotes"], v["docs"], store=store).withColumn("issues", F.array_join("issues", "|"))


def _items(v):
    return v["quotes"].select("doc_id", "ord", F.col("obligation_id").alias("item_id"), F.lit("obligation").alias("item_type"), "source_text")


def audit_exact(v):
    """What an audit decides without a search; a null ratio needs one."""
    return audit.exact_quotes(_items(v), v["docs"])


def audit_statuses(v):
    return audit.verify_quotes(_items(v), v["docs"], store=work_path(v["docs"].sparkSession, "exact-audit"))


def audit_tallies(v):
    return audit.status_tallies(audit.quote_statuses(_items(v), v["docs"], store=work_path(v["docs"].sparkSession, "exact-tallies")))


def potential_misses(v):
    return audit.potential_misses(keyword_sentences(v), v["quotes"], store=work_path(v["docs"].sparkSession, "sentences"))


def eval_greedy_similarity(v):
    return evaluate.match_obligations(v["clauses"], _truth(v))


def unmatched_obligations(v):
    """The unmatched of matches by ready scores, for which there is SQL."""
    m = evaluate.match_by_score(_scores(v), 0.95).withColumns({"match_type": F.when(F.col("truth_ord").isNull(), "none").otherwise("exact"), "system_id": F.format_string("OBL-%03d", "ord"), "details": F.lit("no match")})
    return evaluate.unmatched_lines(m, 2)


def console_summary(v):
    parties = v["clauses"].select("doc_id", "ord", F.col("party").alias("name"), F.lit("party").alias("role"), (F.col("party") == "Tenant").alias("is_reader"))
    # results are counted, and listed by status: worked out once; flags are listed alone, as the summary shows no high risks among what is to be reviewed
    results = stored(_results(v).select("doc_id", "ord", "obligation_id", "status", "confidence", "issues", "is_hallucination"), work_path(v["docs"].sparkSession, "console-results"))
    flags = risk.score_risks(v["clauses"])
    review = report.review_queue(results, flags).where("type <> 'high_risk'").select("doc_id", "branch", "ord", "set_ord", "obligation_id", "type", "reason")
    shown = flags.select("doc_id", "ord", "set_ord", "severity", "title", "source_location")
    listed = lambda df, order, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in ("doc_id", *order)]))).alias(name))
    rows = _header(v).join(listed(shown, ("ord", "set_ord"), "risk_flags"), "doc_id", "left").join(listed(review, ("branch", "ord", "set_ord"), "items_needing_review"), "doc_id", "left")
    return report.console_summary(rows.join(verify.verification_report(results), "doc_id", "left"), parties)


def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of a length rule for quality, by language."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars")
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(d, "doc_id").withColumn("p", (F.col("n_chars") > 1000).cast("int"))
    n = rows.groupBy("lang").agg(F.count_if((F.col("p") == 1) & (F.col("quality") == 1)).alias("tp"), F.sum("p").alias("predicted"), F.sum("quality").alias("positive"))
    return n.withColumns({k: F.round(c, 6) for k, c in evaluate.prf(F.col("tp"), F.col("predicted"), F.col("positive")).items()})


VIEWED = [quote_exact, quote_verify_rollup, quote_key_phrases, quote_original_sentence, page_location, section_headers, paragraphs, paragraph_sections, paginate, chunk_fold, keyword_sentences, keyword_top3, keyword_priority_top10, rule_match, rule_first_per_category, obligation_risk_rollup, auto_renewal_flag, risk_summary, json_extract_tolerant, merge_parties, merge_metadata, renumber_obligations, merge_definitions, report_join, review_queue, report_summary_text, eval_party_sets, eval_greedy_match, eval_prf1, fuzzy_verify, audit_exact, audit_statuses, audit_tallies, potential_misses, eval_greedy_similarity, unmatched_obligations, console_summary]
DIRECT = [label_metrics]


def queries() -> dict[str, Query]:
    out = {f.__name__: (lambda spark, sf_dir, f=f: f(views(spark, sf_dir))) for f in VIEWED}
    return out | {f.__name__: f for f in DIRECT}


# --- SQL -----------------------------------------------------------------------------


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _norm(x: str) -> str:
    return _strip(f"translate(regexp_replace(lower({x}), '\\s+', ' ', 'g'), '`–—', '\"--')")


T = "lower(concat(coalesce(description, ''), ' ', coalesce(source_text, ''), ' ', coalesce(conditions, '')))"
SECTION_TEST = " OR ".join(f"regexp_matches(name, {_q(p)})" for p in structure.SECTION_PATTERNS)


def _test(pattern: str) -> str:
    """RE2 has no lookahead: two rules are rewritten."""
    if pattern.startswith("(?:material|"):
        return r"regexp_matches(regexp_replace(t, '(material|substantial)\s+(all|breach)', '#', 'g'), 'material|substantial')"
    if pattern.startswith("(?:promptly|"):
        return r"regexp_matches(t, '(?:promptly|timely)(?:$|\S|\s+(?:$|[^\s\d]))')"
    return f"regexp_matches(t, {_q(pattern)})"


def _first(category: str) -> str:
    return "CASE " + " ".join(f"WHEN {_test(p)} THEN {_q(title)}" for p, title in risk.RULES[category][4]) + " END"


FLAGS = "flags AS (" + " UNION ALL ".join(
    f"SELECT doc_id, ord, {k} AS set_ord, id AS obligation_id, {_q(c)} AS category, {_q(risk.RULES[c][0])} AS severity, title, concat(title, {_q(' detected. ' + risk.RULES[c][3])}, description) AS description FROM (SELECT *, {_first(c)} AS title FROM (SELECT *, {T} AS t FROM clauses)) WHERE title IS NOT NULL"
    for k, c in enumerate(risk.CATEGORIES)
) + ")"
ACTION = "CASE category " + " ".join(f"WHEN {_q(c)} THEN {_q(risk.RULES[c][1])}" for c in risk.CATEGORIES) + " END"
RANK = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
SUMMARY = f"""summary AS (SELECT *, CASE WHEN high >= 2 THEN 'high' WHEN high >= 1 OR medium >= 3 THEN 'medium' ELSE 'low' END AS overall FROM (
  SELECT doc_id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
  first(concat(title, ' (', category, ')') ORDER BY {RANK} DESC, ord, set_ord) AS most_concerning FROM flags GROUP BY doc_id))"""
RESULTS = f"""results AS (SELECT q.doc_id, q.ord, q.obligation_id, CASE WHEN trim(q.source_text) = '' THEN 'empty' WHEN contains(raw_text, q.source_text) OR contains({_norm("raw_text")}, {_norm("q.source_text")}) THEN 'verified' ELSE 'unverified' END AS status,
  CASE WHEN trim(q.source_text) = '' THEN 0.0::DOUBLE WHEN contains(raw_text, q.source_text) THEN 1.0 WHEN contains({_norm("raw_text")}, {_norm("q.source_text")}) THEN 0.95 ELSE 0.0 END AS confidence
  FROM quotes AS q JOIN docs USING (doc_id))"""
REPORT = """report AS (SELECT doc_id, total, verified, partial, unverified, empty, unverified > 0 AS has_hallucinations, CASE WHEN total = empty THEN 1.0 ELSE (verified + partial) / (total - empty) END AS rate FROM (
  SELECT doc_id, count(*) AS total, count(*) FILTER (status = 'verified') AS verified, 0::BIGINT AS partial, count(*) FILTER (status = 'unverified') AS unverified, count(*) FILTER (status = 'empty') AS empty FROM results GROUP BY doc_id))"""
LINES = "lines AS (SELECT doc_id, unnest(l) AS raw, unnest(range(len(l)))::INT AS line FROM (SELECT doc_id, string_split(raw_text, chr(10)) AS l FROM docs))"
HEADS = f"heads AS (SELECT doc_id, 1 AS page, line, name FROM (SELECT doc_id, line, {_strip('raw')} AS name FROM lines) WHERE name <> '' AND ({SECTION_TEST}))"
PARAS = r"paras AS (SELECT doc_id, 1 AS page, (unnest(range(len(l))))::INT AS ord, unnest(l) AS text FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(raw_text, '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS l FROM docs))"
SENTENCES = (
    LINES
    + r""", parts AS (SELECT doc_id, line + 1 AS line_number, unnest(l) AS s, unnest(range(len(l)))::INT AS ord FROM (SELECT doc_id, line, string_split(regexp_replace(raw, '([.;])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM lines)),
found AS (SELECT * FROM (SELECT doc_id, line_number, ord, sentence, CASE """
    + " ".join(f"WHEN regexp_matches(sentence, {_q(p)}, 'i') THEN {_q(k)}" for k, p in audit.KEYWORDS.items())
    + f" END AS keyword FROM (SELECT doc_id, line_number, ord, {_strip('s')} AS sentence FROM parts) WHERE length(sentence) >= 10) WHERE keyword IS NOT NULL)"
)
PRIORITY = "CASE keyword " + " ".join(f"WHEN {_q(k)} THEN {i}" for i, k in enumerate(audit.PRIORITY)) + " END"
PARSED = r"""j AS (SELECT doc_id, chunk_index, CASE WHEN regexp_matches(response, '```json') THEN regexp_extract(response, '(?s)```(?:json)?\s*(.*?)\s*```', 1) ELSE response END AS body FROM responses),
parsed AS (SELECT doc_id, chunk_index, NOT json_valid(body) AS error, CASE WHEN json_valid(body) THEN body END AS body FROM j)"""
ITEMS = "SELECT doc_id, chunk_index, unnest(range(json_array_length(body, '$.{0}')::BIGINT)) AS pos, unnest(json_extract(body, '$.{0}[*]')) AS x FROM parsed WHERE body IS NOT NULL"
TRUTH = "truth AS (SELECT * FROM clauses WHERE (doc_id + ord) % 4 <> 0)"
PHRASES = r"""p AS (SELECT doc_id, ord, lower(raw_text) AS d, list_slice(list_concat(
  regexp_extract_all(source_text, '"([^"]+)"', 1), regexp_extract_all(source_text, '\$[\d,]+(?:\.\d{2})?'), regexp_extract_all(source_text, '\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b'),
  list_transform(list_filter(range(1, greatest(len(w) - 1, 1)), lambda i: len(list_filter(w[i:i + 2], lambda y: NOT list_contains(common, lower(y)))) > 0), lambda i: array_to_string(w[i:i + 2], ' '))), 1, 10) AS phrases
  FROM (SELECT q.doc_id, q.ord, q.source_text, raw_text, list_filter(regexp_split_to_array(q.source_text, '\s+'), lambda y: y <> '') AS w, %s AS common FROM quotes AS q JOIN docs USING (doc_id)))""" % ("[" + ", ".join(_q(w) for w in verify.COMMON) + "]")


#: An obligation's options in their order, and the fold that takes the first one left.
GREEDY = f"""{TRUTH}, scores AS (SELECT c.doc_id, c.ord, t.ord AS truth_ord, CASE WHEN c.party = t.party THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN c.type = t.type THEN 0.375::DOUBLE ELSE 0.125 END AS score FROM clauses AS c JOIN truth AS t USING (doc_id)),
options AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k, l FROM (SELECT doc_id, ord, list(struct_pack(t := truth_ord, s := score) ORDER BY score DESC, truth_ord) FILTER (score >= LEAST) AS l FROM scores GROUP BY doc_id, ord)),
fold AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, []::INT[] AS used, NULL::INT AS ord, NULL::STRUCT(t INT, s DOUBLE) AS b FROM options
  UNION ALL SELECT doc_id, k, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.t) END, ord, b FROM (
    SELECT o.doc_id, o.k, f.used, o.ord, list_filter(o.l, lambda x: NOT list_contains(f.used, x.t))[1] AS b FROM fold AS f JOIN options AS o ON o.doc_id = f.doc_id AND o.k = f.k + 1)),
matched AS (SELECT doc_id, ord, b.t AS truth_ord, b.s AS score FROM fold WHERE k > 0)"""


def _pages(size: int) -> str:
    """Pages as a fold over the parts of a document; ``whole`` lists them."""
    step = f"length(cur) + length(p) > {size} AND cur <> ''"
    ended = f"CASE WHEN {_strip('cur')} <> '' THEN list_append(done, {_strip('cur')}) ELSE done END"
    return f"""parts AS (SELECT doc_id, unnest(l) AS p, unnest(range(len(l))) + 1 AS k, len(l) AS n FROM (SELECT doc_id, string_split(raw_text, concat(chr(10), chr(10))) AS l FROM docs)),
fold AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, ''::VARCHAR AS cur, []::VARCHAR[] AS done, n FROM parts
  UNION ALL SELECT f.doc_id, p.k, CASE WHEN cur = '' OR {step} THEN p ELSE concat(cur, chr(10), chr(10), p) END, CASE WHEN {step} THEN list_append(done, {_strip("cur")}) ELSE done END, f.n FROM fold AS f JOIN parts AS p ON p.doc_id = f.doc_id AND p.k = f.k + 1),
whole AS (SELECT doc_id, {ended} AS l FROM fold WHERE k = n)"""


def _last(text: str, mark: str) -> str:
    """Where ``mark``, two characters, last starts in ``text``, from 0; -1 if it is not there."""
    return f"CASE WHEN contains({text}, {mark}) THEN length({text}) - 1 - position(reverse({mark}) IN reverse({text})) ELSE -1 END"


def _chunks(size: int, overlap: int) -> str:
    """Chunks as a fold over the paragraphs of a document."""
    tail = f"right(cur, {overlap})"
    cut = "greatest(" + ", ".join(_last(tail, f"concat('.', {c})") for c in ("' '", "chr(10)", "chr(9)")) + ")"
    gap = f"position(concat(chr(10), chr(10)) IN {tail})"
    kept = f"CASE WHEN length(cur) <= {overlap} THEN cur WHEN {cut} > 0 THEN substr({tail}, {cut} + 3) WHEN {gap} > 1 THEN substr({tail}, {gap} + 2) ELSE {tail} END"
    longer = "CASE WHEN cur = '' THEN p ELSE concat(cur, chr(10), chr(10), p) END"
    full = f"cur <> '' AND length({longer}) > {size}"
    made = f"struct_pack(text := {_strip('cur')}, start_page := first, end_page := page, sections := array_to_string(names, '|'))"
    return f"""{_pages(structure.CHARS_PER_PAGE)}, page_rows AS (SELECT doc_id, (unnest(range(len(l))) + 1)::INT AS page, unnest(l) AS text, len(l)::INT AS pages FROM whole),
page_parts AS (SELECT doc_id, page, pages, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: {SECTION_TEST.replace("name", "x")}) AS heads,
  unnest(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: {_strip('x')}), lambda x: x <> '')) AS p, generate_subscripts(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: {_strip('x')}), lambda x: x <> ''), 1) AS ord FROM page_rows),
paras AS (SELECT doc_id, page, pages, p, list_filter(heads, lambda h: contains(p, h) OR contains(h, p)) AS heads, row_number() OVER (PARTITION BY doc_id ORDER BY page, ord) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM page_parts),
chunking AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, ''::VARCHAR AS cur, 1 AS first, []::VARCHAR[] AS names, []::STRUCT(text VARCHAR, start_page INT, end_page INT, sections VARCHAR)[] AS made, n, pages FROM paras
  UNION ALL SELECT doc_id, k, CASE WHEN is_full THEN CASE WHEN tail = '' THEN p ELSE concat(tail, chr(10), chr(10), p) END ELSE longer END, CASE WHEN is_full THEN page ELSE first END, CASE WHEN is_full THEN heads ELSE list_concat(names, heads) END, CASE WHEN is_full THEN list_append(made, made_now) ELSE made END, n, pages FROM (
    SELECT c.doc_id, p.k, first, names, made, c.n, c.pages, p.page, p, heads, {full} AS is_full, {longer} AS longer, {kept} AS tail, {made} AS made_now FROM chunking AS c JOIN paras AS p ON p.doc_id = c.doc_id AND p.k = c.k + 1)),
ended AS (SELECT doc_id, list_append(made, {made.replace(":= page", ":= pages")}) AS l FROM chunking WHERE k = n)
SELECT doc_id, chunk_index, total_chunks, c.text AS text, c.start_page AS start_page, c.end_page AS end_page, c.sections AS sections, length(c.text)::INT AS char_count,
  CASE WHEN c.start_page = c.end_page THEN concat('Page ', c.start_page) ELSE concat('Pages ', c.start_page, '-', c.end_page) END AS source_location
FROM (SELECT doc_id, unnest(l) AS c, unnest(range(len(l)))::INT AS chunk_index, len(l)::INT AS total_chunks FROM ended)"""


def _block(rows: str, most: int, head: str, line: str) -> str:
    """Lines of the first rows of a list, a head before them and a blank line after."""
    shown = f"list_transform(range(1, least(len({rows}), {most}) + 1), lambda i: concat({line}, {rows}[i]))"
    more = f"CASE WHEN len({rows}) > {most} THEN [concat('  ... and ', len({rows}) - {most}, ' more')] ELSE []::VARCHAR[] END"
    return f"CASE WHEN {rows} IS NULL THEN []::VARCHAR[] ELSE [concat({_q(head)}, ' (', len({rows}), '):')] || {shown} || {more} || [''] END"


CONSOLE = f"""WITH {FLAGS}, {RESULTS}, {REPORT},
who AS (SELECT doc_id, string_agg(w, ', ' ORDER BY o) AS who FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS k FROM (SELECT doc_id, w, min(ord) AS o FROM (SELECT doc_id, ord, concat(party, CASE WHEN party = 'Tenant' THEN ' (You)' ELSE ' (party)' END) AS w FROM clauses) GROUP BY doc_id, w)) WHERE k <= 2 GROUP BY doc_id),
flagged AS (SELECT doc_id, list(t ORDER BY ord, set_ord) FILTER (severity = 'high') AS high, list(t ORDER BY ord, set_ord) FILTER (severity = 'medium') AS medium FROM (SELECT f.doc_id, f.ord, set_ord, severity, concat(title, ' ', CASE WHEN coalesce(source_location, '') <> '' THEN concat('(', source_location, ')') ELSE '' END) AS t FROM flags AS f JOIN clauses AS c ON c.doc_id = f.doc_id AND c.ord = f.ord) GROUP BY doc_id),
review AS (SELECT doc_id, list(concat(obligation_id, ': Source text could not be verified') ORDER BY ord) AS l FROM results WHERE status = 'unverified' GROUP BY doc_id)
SELECT doc_id, array_to_string(
  [concat('Document: ', doc_id)] || CASE WHEN who IS NULL THEN []::VARCHAR[] ELSE [concat('Parties: ', who)] END || CASE WHEN doc_id % 2 = 0 THEN ['Term: 2 years'] ELSE []::VARCHAR[] END || ['']
  || {_block("high", 5, "[HIGH RISK FLAGS]", "'  ', i, '. '")} || {_block("medium", 5, "[MEDIUM RISK FLAGS]", "'  ', i, '. '")} || {_block("l", 3, "[!] ITEMS NEEDING HUMAN REVIEW", "'  - '")}
  || CASE WHEN has_hallucinations THEN ['[WARNING] Possible hallucinations detected - review flagged items'] WHEN rate < 1 THEN [concat('[NOTE] Verification rate: ', round_even(rate * 100, 0)::INT, '%')] ELSE []::VARCHAR[] END, chr(10)) AS text
FROM renewals LEFT JOIN who USING (doc_id) LEFT JOIN flagged USING (doc_id) LEFT JOIN review USING (doc_id) LEFT JOIN report USING (doc_id)"""


def _folds() -> dict[str, str]:
    """SQL of what depends on the rows before."""
    return {
        "paginate": f"WITH {_pages(200)} SELECT doc_id, (unnest(range(len(l))) + 1)::INT AS page, unnest(l) AS text FROM whole",
        "chunk_fold": f"WITH {_chunks(400, 80)}",
        "eval_greedy_match": f"WITH {GREEDY.replace('LEAST', '0.6')} SELECT * FROM matched",
        "unmatched_obligations": f"WITH {GREEDY.replace('LEAST', '0.95')} SELECT doc_id, n, CASE WHEN n <= 2 THEN concat('OBL-', lpad(ord::VARCHAR, 3, '0'), ': no match') ELSE concat('... and ', m - 2, ' more') END AS line FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY ord))::INT AS n, count(*) OVER (PARTITION BY doc_id) AS m FROM matched WHERE truth_ord IS NULL) WHERE n <= 3",
    }


def oracle_sql() -> dict[str, str]:
    body = {
        "quote_exact": f"WITH {RESULTS} SELECT doc_id, ord, status, confidence FROM results",
        "quote_verify_rollup": f"WITH {RESULTS}, {REPORT} SELECT * REPLACE (round(rate, 3) AS rate) FROM report",
        "quote_key_phrases": f"WITH {PHRASES} SELECT doc_id, ord, len(phrases)::INT AS n_phrases, len(list_filter(phrases, lambda x: contains(d, lower(x))))::INT AS n_found FROM p",
        "quote_original_sentence": f"SELECT q.doc_id, q.ord, {_strip('list_filter(regexp_split_to_array(raw_text, ' + _q('[.!?]' + chr(92) + 's+') + '), lambda s: contains(' + _norm('s') + ', ' + _norm('q.source_text') + '))[1]')} AS sentence FROM quotes AS q JOIN docs USING (doc_id) WHERE trim(q.source_text) <> ''",
        "page_location": "WITH pages AS (SELECT doc_id, min(ord) AS page, source_text FROM clauses GROUP BY doc_id, source_text) SELECT c.doc_id, c.ord, coalesce(c.source_location, concat('Page ', page)) AS location FROM clauses AS c JOIN pages USING (doc_id, source_text)",
        "section_headers": f"WITH {LINES}, {HEADS} SELECT doc_id, page, line, name FROM heads",
        "paragraphs": f"WITH {PARAS} SELECT * FROM paras",
        "paragraph_sections": f"WITH {PARAS}, {LINES}, {HEADS} SELECT p.doc_id, p.ord, coalesce(string_agg(name, '|' ORDER BY line) FILTER (contains(text, name) OR contains(name, text)), '') AS sections FROM paras AS p LEFT JOIN heads USING (doc_id, page) GROUP BY p.doc_id, p.ord",
        "keyword_sentences": f"WITH {SENTENCES} SELECT * FROM found",
        "keyword_top3": f"WITH {SENTENCES} SELECT doc_id, keyword, n, of, sentence FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id, keyword ORDER BY line_number, ord))::INT AS n, count(*) OVER (PARTITION BY doc_id, keyword) AS of FROM found) WHERE n <= 3",
        "keyword_priority_top10": f"WITH {SENTENCES} SELECT doc_id, n, keyword, sentence FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY {PRIORITY}, line_number, ord))::INT AS n FROM found WHERE {PRIORITY} IS NOT NULL) WHERE n <= 10",
        "rule_match": "WITH x AS (SELECT " + T + " AS t FROM clauses), m AS (" + " UNION ALL ".join(f"SELECT {_q(c)} AS category, {k} AS rule, count(*) AS n FROM x WHERE {_test(p)}" for c in risk.CATEGORIES for k, (p, _) in enumerate(risk.RULES[c][4])) + ") SELECT * FROM m WHERE n > 0",
        "rule_first_per_category": f"WITH {FLAGS} SELECT doc_id, ord, category, severity, title, description FROM flags",
        "obligation_risk_rollup": f"WITH {FLAGS} SELECT doc_id, obligation_id, first(severity ORDER BY {RANK} DESC) AS risk_level, string_agg(title, '|' ORDER BY set_ord) AS risk_flags FROM flags GROUP BY doc_id, obligation_id",
        "auto_renewal_flag": r"SELECT doc_id, CASE WHEN try_cast(regexp_extract(lower(notice), '(\d+)\s*(?:days?|business\s+days?)', 1) AS INT) < 30 THEN 'medium' ELSE 'low' END AS severity, concat('Contract automatically renews for ', coalesce(period, 'unspecified period'), '. Notice required to cancel: ', coalesce(notice, 'not specified'), '.') AS description FROM renewals WHERE renews",
        "risk_summary": f"WITH {FLAGS}, {SUMMARY} SELECT * FROM summary",
        "json_extract_tolerant": f"WITH {PARSED} SELECT doc_id, chunk_index, error, body->>'$.term' AS term, CASE WHEN error THEN 'JSON parsing error' ELSE body->>'$.extraction_notes' END AS notes FROM parsed",
        "merge_parties": f"WITH {PARSED}, x AS ({ITEMS.format('parties')}), f AS (SELECT *, x->>'$.name' AS name, x->>'$.role' AS role, row_number() OVER (PARTITION BY doc_id, x->>'$.name' ORDER BY chunk_index, pos) AS k FROM x) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, pos))::INT AS ord, name, role FROM f WHERE k = 1",
        "merge_metadata": f"WITH {PARSED}, x AS (SELECT doc_id, chunk_index, body->>'$.term' AS term, CASE WHEN error THEN 'JSON parsing error' ELSE body->>'$.extraction_notes' END AS notes FROM parsed) SELECT doc_id, first(term ORDER BY chunk_index) FILTER (term <> '') AS term, coalesce(string_agg(notes, chr(10) ORDER BY chunk_index) FILTER (notes <> ''), '') AS notes, count(*) AS chunks_processed FROM x GROUP BY doc_id",
        "renumber_obligations": f"WITH {PARSED}, x AS ({ITEMS.format('obligations')}) SELECT doc_id, concat('OBL-', lpad((row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, pos))::VARCHAR, 3, '0')) AS id, coalesce(x->>'$.party', 'Unknown') AS party, 'requirement' AS type, x->>'$.description' AS description, coalesce(x->>'$.source_location', 'Unknown') AS source_location FROM x",
        "merge_definitions": f"WITH {PARSED}, x AS ({ITEMS.format('key_definitions')}), f AS (SELECT *, x->>'$.term' AS term, row_number() OVER (PARTITION BY doc_id, x->>'$.term' ORDER BY chunk_index, pos) AS k FROM x) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, pos))::INT AS ord, term, x->>'$.definition' AS definition, coalesce(x->>'$.source_location', 'Unknown') AS source_location FROM f WHERE k = 1 AND term <> ''",
        "report_join": f"WITH {FLAGS}, {RESULTS}, r AS (SELECT doc_id, obligation_id, first(severity ORDER BY {RANK} DESC) AS level, count(*)::INT AS n, string_agg(title, '|' ORDER BY set_ord) AS titles FROM flags GROUP BY ALL) SELECT c.doc_id, c.ord, c.id, coalesce(level, 'low') AS risk_level, coalesce(n, 0) AS n_flags, coalesce(titles, '') AS risk_flags, status = 'verified' AS verified FROM clauses AS c LEFT JOIN r ON r.doc_id = c.doc_id AND r.obligation_id = c.id JOIN results AS v ON v.doc_id = c.doc_id AND v.ord = c.ord",
        "review_queue": f"WITH {FLAGS}, {RESULTS} SELECT doc_id, 0 AS branch, ord, 0 AS set_ord, obligation_id, 'possible_hallucination' AS type, 'Source text could not be verified' AS reason, confidence, NULL::VARCHAR AS category, NULL::VARCHAR AS action_required FROM results WHERE status = 'unverified' UNION ALL SELECT doc_id, 2, ord, set_ord, obligation_id, 'high_risk', concat('High-risk clause: ', title), NULL, category, {ACTION} FROM flags WHERE severity = 'high'",
        "report_summary_text": f"""WITH {FLAGS}, {SUMMARY}, {RESULTS}, {REPORT}, who AS (SELECT doc_id, string_agg(concat(party, ' (party)', CASE WHEN party = 'Tenant' THEN ' (You)' ELSE '' END), ', ' ORDER BY ord) AS who FROM (SELECT doc_id, party, min(ord) AS ord FROM clauses GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, concat_ws(chr(10), 'Parties: ' || who, CASE WHEN doc_id % 2 = 0 THEN 'Term: 2 years' END, CASE WHEN renews THEN concat('Auto-Renewal: ', coalesce(period, 'Yes'), ', notice required: ', coalesce(notice, 'unspecified')) END,
  concat('Total Obligations: ', coalesce(total, 0)), concat('Verification: ', coalesce(verified, 0), '/', coalesce(total, 0), ' verified (', round_even(coalesce(rate, 1.0) * 100, 0)::INT, '%)'), 'Overall Risk: ' || upper(coalesce(overall, 'low')),
  CASE WHEN high > 0 THEN concat('High-Risk Flags: ', high) END, CASE WHEN medium > 0 THEN concat('Medium-Risk Flags: ', medium) END, 'Most Concerning: ' || most_concerning) AS summary
FROM renewals LEFT JOIN who USING (doc_id) LEFT JOIN report USING (doc_id) LEFT JOIN summary USING (doc_id)""",
        "console_summary": CONSOLE,
        "audit_exact": f"""WITH x AS (SELECT q.doc_id, q.ord, q.obligation_id AS item_id, 'obligation' AS item_type, q.source_text, coalesce(q.source_text, '') = '' AS none, contains(lower({_strip(r"regexp_replace(raw_text, '\s+', ' ', 'g')")}), lower({_strip(r"regexp_replace(q.source_text, '\s+', ' ', 'g')")})) AS held FROM quotes AS q JOIN docs USING (doc_id))
SELECT doc_id, ord, item_id, item_type, source_text, CASE WHEN none THEN 0.0::DOUBLE WHEN held THEN 1.0 END AS match_ratio, CASE WHEN NOT none AND held THEN source_text END AS best_match_text FROM x""",
        "eval_party_sets": f"WITH {TRUTH}, s AS (SELECT DISTINCT doc_id, lower(party) AS n FROM clauses), t AS (SELECT DISTINCT doc_id, CASE WHEN ord % 3 = 0 THEN lower(party) || ' ltd' ELSE lower(party) END AS n FROM truth), b AS (SELECT doc_id, n, max(a) AS a, max(b) AS b FROM (SELECT doc_id, n, 1 AS a, 0 AS b FROM s UNION ALL SELECT doc_id, n, 0, 1 FROM t) GROUP BY doc_id, n) SELECT doc_id, coalesce(string_agg(n, '|' ORDER BY n) FILTER (a = 1 AND b = 1), '') AS matched, coalesce(string_agg(n, '|' ORDER BY n) FILTER (b = 0), '') AS extra, coalesce(string_agg(n, '|' ORDER BY n) FILTER (a = 0), '') AS missing FROM b GROUP BY doc_id",
        "eval_prf1": f"WITH {TRUTH}, m AS (SELECT doc_id, count(*) FILTER ((doc_id + ord) % 4 <> 0) AS tp, count(*) FILTER ((doc_id + ord) % 4 = 0) AS fp FROM clauses WHERE ord % 5 <> 0 GROUP BY doc_id), t AS (SELECT doc_id, count(*) AS n FROM truth GROUP BY doc_id), x AS (SELECT doc_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(n, 0) AS n FROM m FULL JOIN t USING (doc_id)), y AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN n > 0 THEN tp / n ELSE 0 END AS r FROM x) SELECT doc_id, tp, fp, n - tp AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM y",
    }
    out = {k: duck(v) for k, v in body.items()} | {k: duck(v).replace("WITH ", "WITH RECURSIVE ", 1) for k, v in _folds().items()}
    out["label_metrics"] = "WITH x AS (SELECT lang, count(*) FILTER (n_chars > 1000 AND quality = 1) AS tp, count(*) FILTER (n_chars > 1000) AS predicted, sum(quality)::BIGINT AS positive FROM labels JOIN documents USING (doc_id) GROUP BY lang), y AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS p, coalesce(tp / nullif(positive, 0), 0) AS r FROM x) SELECT lang, tp, predicted, positive, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM y"
    return out
