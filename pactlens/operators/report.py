"""Reports: obligations with their risks and verification, a review queue, renderers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.named_files import with_file_stem, write_named
from .risk import severity_rank


def join_obligations(obligations: DataFrame, flags: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, ord, id, risk_level, n_flags, risk_flags, verified): obligations, left-joined
    to their highest risk and the titles of all, and to the last verification result of
    their id; verified if none."""
    titles = F.transform(F.array_sort(F.collect_list(F.struct("ord", "set_ord", "title"))), lambda x: x["title"])
    risks = flags.groupBy("doc_id", F.col("obligation_id").alias("id")).agg(F.max_by("severity", severity_rank(F.col("severity"))).alias("level"), titles.alias("titles"))
    last = results.groupBy("doc_id", F.col("obligation_id").alias("id")).agg(F.max_by(F.col("status").isin("verified", "partial"), "ord").alias("ok"))
    rows = obligations.join(risks, ["doc_id", "id"], "left").join(last, ["doc_id", "id"], "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
    return rows.select("doc_id", "ord", "id", F.coalesce("level", F.lit("low")).alias("risk_level"), F.size("titles").alias("n_flags"), F.col("titles").alias("risk_flags"), F.coalesce("ok", F.lit(True)).alias("verified"))


def review_queue(results: DataFrame, flags: DataFrame) -> DataFrame:
    """(doc_id, branch, ord, set_ord, obligation_id, type, reason, confidence, details,
    category, action_required): unverified quotes, then partial ones, then high risks."""
    out = None
    for branch, (status, kind, reason) in enumerate((("unverified", "possible_hallucination", "Source text could not be verified"), ("partial", "partial_match", "Partial match - verify source text"))):
        part = results.where(F.col("status") == status).select("doc_id", F.lit(branch).alias("branch"), F.col("ord").cast("int").alias("ord"), F.lit(0).alias("set_ord"), "obligation_id", F.lit(kind).alias("type"), F.lit(reason).alias("reason"), "confidence", F.col("issues").alias("details"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("action_required"))
        out = part if out is None else out.unionByName(part)
    high = flags.where(F.col("severity") == "high").select("doc_id", F.lit(2).alias("branch"), "ord", "set_ord", "obligation_id", F.lit("high_risk").alias("type"), F.concat(F.lit("High-risk clause: "), "title").alias("reason"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("array<string>").alias("details"), "category", "action_required")
    return out.unionByName(high)


def percent(rate: Column, places: int = 0) -> Column:
    return F.format_string(f"%.{places}f%%", F.bround(rate * 100, places))


def summary_text(header: DataFrame, parties: DataFrame, obligations: DataFrame, report: DataFrame, summary: DataFrame) -> DataFrame:
    """(doc_id, summary): one line for each fact that there is."""
    who = F.concat("name", F.lit(" ("), "role", F.lit(")"), F.when(F.col("is_reader"), " (You)").otherwise(""))
    p = parties.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", who.alias("who")))), lambda x: x["who"]), ", ").alias("who"))
    n = obligations.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_obligations"))
    rows = header.join(p, "doc_id", "left").join(n, "doc_id", "left").join(report, "doc_id", "left").join(summary, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    term, date = F.nullif("term", F.lit("")), F.nullif("effective_date", F.lit(""))
    when = F.array_join(F.array_compact(F.array(term, F.concat(F.lit("starting "), date))), " ")
    ar = F.col("auto_renewal")
    lines = F.array(
        F.concat(F.lit("Parties: "), "who"),
        F.when(when != "", F.concat(F.lit("Term: "), when)),
        F.when(ar["exists"], F.concat(F.lit("Auto-Renewal: "), F.coalesce(F.nullif(ar["period"], F.lit("")), F.lit("Yes")), F.lit(", notice required: "), F.coalesce(F.nullif(ar["notice_to_cancel"], F.lit("")), F.lit("unspecified")))),
        F.concat(F.lit("Total Obligations: "), zero("n_obligations")),
        F.concat(F.lit("Verification: "), zero("verified"), F.lit("/"), zero("total"), F.lit(" verified ("), percent(F.coalesce("rate", F.lit(1.0))), F.lit(")")),
        F.concat(F.lit("Overall Risk: "), F.upper(F.coalesce("overall", F.lit("low")))),
        F.when(F.col("high") > 0, F.concat(F.lit("High-Risk Flags: "), "high")),
        F.when(F.col("medium") > 0, F.concat(F.lit("Medium-Risk Flags: "), "medium")),
        F.concat(F.lit("Most Concerning: "), "most_concerning"),
    )
    return rows.select("doc_id", F.array_join(F.array_compact(lines), "\n").alias("summary"))


def listed(df: DataFrame, name: str, order: list[str], *cols: str) -> DataFrame:
    """(doc_id, ``name``): each document's rows as one list of ``cols``, in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*cols).alias("row"))))
    return df.groupBy("doc_id").agg(F.transform(rows, lambda x: x["row"]).alias(name))


PARTY = ["name", "role", "is_reader"]
OBLIGATION = ["id", "party", "type", "description", "deadline", "conditions", "source_text", "source_location", "risk_level", "risk_flags", "verified"]
FLAG = ["obligation_id", "category", "severity", "title", "description", "source_text", "source_location", "action_required", "negotiation_suggestion"]
REVIEW = ["type", "obligation_id", "reason", "confidence", "details", "category", "action_required"]
DEFINITION = ["term", "definition", "source_location"]
RESULT = ["obligation_id", "status", "confidence", "source_text", "matched_text", "match_location", "issues", "is_verified", "is_hallucination"]


def build_report(header: DataFrame, parties: DataFrame, definitions: DataFrame, obligations: DataFrame, flags: DataFrame, results: DataFrame, report: DataFrame, summary: DataFrame, summaries: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """One row a document of ``header``: lists in their order, counts, summary. All parts
    are grouped by document, so each is shuffled once."""
    full = obligations.join(join_obligations(obligations, flags, results).select("doc_id", "ord", "risk_level", "risk_flags", "verified"), ["doc_id", "ord"])
    rows = header
    for part in (summaries, report, summary, listed(parties, "parties", ["ord"], *PARTY), listed(definitions, "key_definitions", ["ord"], *DEFINITION), listed(full, "obligations", ["ord"], *OBLIGATION), listed(flags, "risk_flags", ["ord", "set_ord"], *FLAG), listed(review_queue(results, flags), "items_needing_review", ["branch", "ord", "set_ord"], *REVIEW)):
        rows = rows.join(part, "doc_id", "left")
    empty = {c: F.coalesce(c, F.from_json(F.lit("[]"), rows.schema[c].dataType)) for c in ("parties", "key_definitions", "obligations", "risk_flags", "items_needing_review")}
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("high", "medium", "low", "total", "verified", "partial", "unverified", "empty")}
    other = {"overall": F.coalesce("overall", F.lit("low")), "rate": F.coalesce("rate", F.lit(1.0)), "has_hallucinations": F.coalesce("has_hallucinations", F.lit(False))}
    when = F.date_format(F.current_timestamp() if generated_at is None else generated_at, "yyyy-MM-dd'T'HH:mm:ss")
    return rows.withColumns(empty | zero | other | {"file_path": F.col("doc_id").cast("string"), "file_name": F.regexp_extract(F.col("doc_id").cast("string"), r"([^/]*)/?$", 1), "generated_at": when})


def _object(**fields: Column | str) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in fields.items()])


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false", "pretty": "true"})


def _risk_summary() -> Column:
    return _object(high_risk_count="high", medium_risk_count="medium", low_risk_count="low", most_concerning="most_concerning", overall_risk_level="overall")


def report_json(reports: DataFrame) -> DataFrame:
    """(doc_id, json): the report as one object; the key names are fixed values."""
    verification = _object(rate="rate", has_hallucinations="has_hallucinations", items_needing_review="items_needing_review")
    same = ["file_path", "file_name", "generated_at", "parties", "effective_date", "term", "termination_notice_period", "auto_renewal", "obligations", "risk_flags"]
    return reports.select("doc_id", _json(F.struct(*same, _risk_summary().alias("risk_summary"), verification.alias("verification"), "summary", "key_definitions")).alias("json"))


def risks_json(reports: DataFrame) -> DataFrame:
    """(doc_id, json): the risk flags and their summary; the key names are fixed values."""
    return reports.select("doc_id", _json(_object(file_path="file_path", risks="risk_flags", summary=_risk_summary(), obligations_analyzed=F.size("obligations"))).alias("json"))


def verification_json(reports: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, json): every quote's result and the counts; the key names are fixed values."""
    rows = reports.join(listed(results, "results", ["ord"], *RESULT), "doc_id", "left")
    counts = _object(file_path="file_path", total_obligations="total", verified_count="verified", partial_count="partial", unverified_count="unverified", empty_count="empty", verification_rate="rate", has_hallucinations="has_hallucinations", results=F.coalesce("results", F.from_json(F.lit("[]"), rows.schema["results"].dataType)))
    return rows.select("doc_id", _json(counts).alias("json"))


def console_summary(reports: DataFrame, parties: DataFrame) -> DataFrame:
    """(doc_id, text): the few lines that a command line shows of each report: two
    parties, the term, five flags of each upper severity, three quotes to look at."""
    empty = F.array().cast("array<string>")
    who = F.concat("name", F.when(F.col("is_reader"), " (You)").otherwise(F.concat(F.lit(" ("), "role", F.lit(")"))))
    p = parties.groupBy("doc_id").agg(F.array_join(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", who.alias("who")))), lambda x: x["who"])), 1, 2), ", ").alias("who"))

    def some(rows: Column, n: int, head: str, line) -> Column:
        size = F.size(rows)
        shown = F.transform(F.slice(rows, 1, n), line)
        more = F.when(size > n, F.array(F.format_string("  ... and %d more", size - n))).otherwise(empty)
        return F.when(size > 0, F.concat(F.array(F.format_string(head, size)), shown, more, F.array(F.lit("")))).otherwise(empty)

    flag = lambda r, i: F.concat(F.format_string("  %d. ", i + 1), r["title"], F.lit(" "), F.when(F.coalesce(r["source_location"], F.lit("")) != "", F.concat(F.lit("("), r["source_location"], F.lit(")"))).otherwise(""))
    of = lambda severity: F.filter("risk_flags", lambda r: r["severity"] == severity)
    review = F.filter("items_needing_review", lambda i: i["type"] != "high_risk")
    term, date = F.nullif("term", F.lit("")), F.nullif("effective_date", F.lit(""))
    when = F.array_join(F.array_compact(F.array(term, F.concat(F.lit("starting "), date))), " ")
    warning = F.when(F.col("has_hallucinations"), "[WARNING] Possible hallucinations detected - review flagged items").when(F.col("rate") < 1, F.concat(F.lit("[NOTE] Verification rate: "), percent(F.col("rate"))))
    lines = F.concat(
        F.array_compact(F.array(F.concat(F.lit("Document: "), F.col("doc_id").cast("string")), F.concat(F.lit("Parties: "), "who"), F.when(when != "", F.concat(F.lit("Term: "), when)), F.lit(""))),
        some(of("high"), 5, "[HIGH RISK FLAGS] (%d):", flag),
        some(of("medium"), 5, "[MEDIUM RISK FLAGS] (%d):", flag),
        some(review, 3, "[!] ITEMS NEEDING HUMAN REVIEW (%d):", lambda i: F.concat(F.lit("  - "), i["obligation_id"], F.lit(": "), i["reason"])),
        F.array_compact(F.array(warning)),
    )
    return reports.join(p, "doc_id", "left").select("doc_id", F.array_join(lines, "\n").alias("text"))


# --- layouts for reading; their headings and labels are fixed values -------------------

RULE = "=" * 60
UNKNOWN = "Not specified"


def _lines(*parts: Column | str) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _none() -> Column:
    return F.array().cast("array<string>")


def _if(test: Column, lines: Column) -> Column:
    return F.when(test, lines).otherwise(_none())


def _each(rows: Column | str, lines) -> Column:
    """The lines of every row, which ``lines`` makes from the row and its place."""
    return F.flatten(F.transform(rows, lines))


def _text(*parts: Column | str) -> Column:
    """Parts side by side; a missing one is left out."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _severity(level: str) -> Column:
    return F.filter("risk_flags", lambda r: r["severity"] == level)


def _or(column: str, otherwise: str = UNKNOWN) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit(otherwise))


def render_text(reports: DataFrame, shown: int = 10) -> DataFrame:
    """(doc_id, text): the report for reading."""
    head = lambda title: _lines(RULE, title, RULE, "")
    renewal, high, medium, low = F.col("auto_renewal"), _severity("high"), _severity("medium"), _severity("low")
    mark = lambda kind: F.when(kind == "possible_hallucination", "?").when(kind == "high_risk", "!").otherwise("-")
    level = lambda o: F.when(o["risk_level"] == "high", " [HIGH RISK]").when(o["risk_level"] == "medium", " [MEDIUM]")
    count = F.size("obligations")
    blocks = [
        head("CONTRACT ANALYSIS SUMMARY"),
        _lines(_text("Document: ", F.col("file_name")), _text("Generated: ", F.col("generated_at")), ""),
        _if(F.size("parties") > 0, F.concat(_lines("Parties:"), F.transform("parties", lambda p: _text("  - ", p["name"], " (", p["role"], ")", F.when(p["is_reader"], " [YOU]"))), _lines(""))),
        _lines("Contract Terms:", _text("  Effective Date: ", _or("effective_date")), _text("  Term: ", _or("term")), _text("  Termination Notice: ", _or("termination_notice_period"))),
        _if(renewal["exists"], _lines("", "  [!] AUTO-RENEWAL DETECTED", _text("      Period: ", F.coalesce(renewal["period"], F.lit("None"))), _text("      Notice to Cancel: ", F.coalesce(renewal["notice_to_cancel"], F.lit("None"))))),
        _lines(""),
        head(_text("RISK ASSESSMENT: ", F.upper("overall"))),
        _if(F.size(high) > 0, F.concat(_lines("[HIGH RISK] Critical Issues:"), _each(high, lambda r, i: _lines(_text("  ", i + 1, ". ", r["title"]), _text("     ", F.left(r["description"], F.lit(80)), "..."), _text("     Location: ", r["source_location"]), _text("     Action: ", r["action_required"]), "")))),
        _if(F.size(medium) > 0, F.concat(_lines("[MEDIUM RISK] Notable Concerns:"), F.transform(medium, lambda r, i: _text("  ", i + 1, ". ", r["title"], " (", r["source_location"], ")")), _lines(""))),
        _if(F.size(low) > 0, _lines(_text("[LOW RISK] Minor Items: ", F.size(low), " found"), "")),
        _if(F.size("items_needing_review") > 0, F.concat(head("ITEMS NEEDING HUMAN REVIEW"), F.transform("items_needing_review", lambda i: _text("  [", mark(i["type"]), "] ", i["obligation_id"], ": ", i["reason"])), _lines(""))),
        _lines(RULE, "VERIFICATION STATUS", RULE, _text("  Verification Rate: ", percent(F.col("rate"), 1))),
        _lines(F.when(F.col("has_hallucinations"), "  [WARNING] Possible hallucinations detected - review flagged items").otherwise("  All source text verified against original document"), ""),
        head(_text("OBLIGATIONS (", count, " total)")),
        _each(F.slice("obligations", 1, shown), lambda o: F.array_compact(_lines(_text("  [", o["id"], "] ", o["party"], level(o)), _text("    ", F.left(o["description"], F.lit(70)), "..."), F.when(F.coalesce(o["deadline"], F.lit("")) != "", _text("    Deadline: ", o["deadline"])), ""))),
        _if(count > shown, _lines(_text("  ... and ", count - shown, " more obligations"), "")),
        _lines(RULE, "END OF REPORT", RULE),
    ]
    return reports.select("doc_id", F.array_join(F.concat(*blocks), "\n").alias("text"))


def render_markdown(reports: DataFrame, footer: str | None = None) -> DataFrame:
    """(doc_id, markdown): the report as tables; ``footer`` is a last line, if any."""
    renewal, high, medium, low = F.col("auto_renewal"), _severity("high"), _severity("medium"), _severity("low")
    row = lambda *cells: _text("| ", *[x for c in cells for x in (c, " | ")][:-1], " |")
    bold = lambda level: F.when(level == "low", level).otherwise(F.concat(F.lit("**"), F.upper(level), F.lit("**")))
    short = lambda text: F.when(F.char_length(text) > 50, F.concat(F.left(text, F.lit(50)), F.lit("..."))).otherwise(text)
    who = F.array_join(F.transform("parties", lambda p: _text(p["name"], " (", p["role"], ")")), ", ")
    facts = lambda r: F.array_compact(_lines(_text("#### ", r["title"]), "", _text("- **Category:** ", r["category"]), _text("- **Location:** ", r["source_location"]), _text("- **Description:** ", r["description"]), _text("- **Action Required:** ", r["action_required"]), F.when(F.coalesce(r["negotiation_suggestion"], F.lit("")) != "", _text("- **Negotiation Tip:** ", r["negotiation_suggestion"])), ""))
    blocks = [
        _lines(_text("# Contract Analysis: ", F.col("file_name")), "", _text("*Generated: ", F.col("generated_at"), "*"), "", "## Summary", "", "| Field | Value |", "|-------|-------|"),
        _if(F.size("parties") > 0, _lines(row("Parties", who))),
        _lines(row("Effective Date", _or("effective_date")), row("Term", _or("term")), _text("| Overall Risk | **", F.upper("overall"), "** |"), row("Obligations", F.size("obligations")), row("Verification Rate", percent(F.col("rate"), 1)), ""),
        _if(renewal["exists"], _lines("> **Auto-Renewal Warning**", _text("> Period: ", F.coalesce(renewal["period"], F.lit("None"))), _text("> Notice to Cancel: ", F.coalesce(renewal["notice_to_cancel"], F.lit("None"))), "")),
        _lines("## Risk Flags", ""),
        _if(F.size(high) > 0, F.concat(_lines("### High Risk (Immediate Attention Required)", ""), _each(high, facts))),
        _if(F.size(medium) > 0, F.concat(_lines("### Medium Risk (Review Recommended)", "", "| Risk | Category | Location |", "|------|----------|----------|"), F.transform(medium, lambda r: row(r["title"], r["category"], r["source_location"])), _lines(""))),
        _if(F.size(low) > 0, _lines(_text("### Low Risk (", F.size(low), " items)"), "", "Minor issues that may warrant attention but are generally acceptable.", "")),
        _if(F.size("items_needing_review") > 0, F.concat(_lines("## Items Needing Human Review", ""), F.transform("items_needing_review", lambda i: _text("- **", i["obligation_id"], "**: ", i["reason"])), _lines(""))),
        _lines("## Obligations", "", "| ID | Party | Type | Description | Risk |", "|----|-------|------|-------------|------|"),
        F.transform("obligations", lambda o: row(o["id"], o["party"], o["type"], short(o["description"]), bold(o["risk_level"]))),
        _lines("", "---", "", f"*{footer}*") if footer else _none(),
    ]
    return reports.select("doc_id", F.array_join(F.concat(*blocks), "\n").alias("markdown"))


def report_files(reports: DataFrame, save_json: bool = True, save_text: bool = True, save_markdown: bool = False, results: DataFrame | None = None, extracted: DataFrame | None = None) -> DataFrame:
    """(name, content): the files of each document by its name; with ``results`` also those
    of its risk flags and of its verification, with ``extracted`` (doc_id, json) that of
    what was extracted."""
    kinds = []
    if save_json:
        kinds.append((report_json(reports), "json", "_analysis.json"))
    if save_text:
        kinds.append((render_text(reports), "text", "_summary.txt"))
    if save_markdown:
        kinds.append((render_markdown(reports), "markdown", "_report.md"))
    if results is not None:
        kinds += [(risks_json(reports), "json", "_risks.json"), (verification_json(reports, results), "json", "_verification.json")]
    if extracted is not None:
        kinds.append((extracted, "json", "_extraction.json"))
    if not kinds:
        raise ValueError("no kind of file asked for")
    stems = with_file_stem(reports.select("doc_id"))
    out = None
    for rows, column, ending in kinds:
        part = rows.join(stems, "doc_id").select(F.concat("stem", F.lit(ending)).alias("name"), F.col(column).alias("content"))
        out = part if out is None else out.unionByName(part)
    return out


def write_reports(reports: DataFrame, folder: str, save_json: bool = True, save_text: bool = True, save_markdown: bool = False, results: DataFrame | None = None, extracted: DataFrame | None = None) -> None:
    """report_files() written below ``folder``; for millions of documents, tables of
    report_json() and the like are the better form."""
    write_named(report_files(reports, save_json, save_text, save_markdown, results, extracted), folder)
