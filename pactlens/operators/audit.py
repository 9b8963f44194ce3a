"""Audit of annotations: are their quotes in the text, and what did they miss?"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.needed import held, needed
from ..functions.text import Haystack, Ratios, audit_norm, best_window, best_windows, ratio_bound, ratio_from, strip, truncate
from ..session import stored
from .search import beside_documents

#: Keywords of obligations, first match wins; fixed values.
KEYWORDS = {
    "SHALL": r"\bshall\b",
    "MUST": r"\bmust\b",
    "AGREES": r"\bagrees?\b",
    "WARRANTS": r"\bwarrants?\b",
    "COVENANTS": r"\bcovenants?\b",
    "WILL NOT": r"\bwill\s+not\b",
    "MAY NOT": r"\bmay\s+not\b",
    "IS RESPONSIBLE": r"\bis\s+responsible\b",
    "IS REQUIRED": r"\bis\s+required\b",
    "UNDERTAKES": r"\bundertakes?\b",
    "COMMITS": r"\bcommits?\b",
    "OBLIGATED": r"\bobligated\b",
    "PROHIBITED": r"\bprohibited\b",
}
PRIORITY = ["SHALL", "MUST", "AGREES", "WARRANTS", "COVENANTS"]


def keyword(sentence: Column, lower: Column | None = None) -> Column:
    """``lower`` may give the sentence in lower case. Patterns are tried where their
    literals are; where case is ignored some other letters stand for ASCII ones, so a
    sentence that is not all ASCII is always tried."""
    out, lower = None, F.lower(sentence) if lower is None else lower
    other = F.octet_length(sentence) != F.char_length(sentence)
    for name, pattern in KEYWORDS.items():
        test = (other | held(lower, needed(pattern))) & sentence.rlike("(?iuUd)" + pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def keyword_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, line_number, ord, sentence, keyword): lines count from 1."""
    lines = docs.select("doc_id", F.posexplode(F.split("raw_text", "\n")).alias("line", "text"))
    parts = lines.select("doc_id", (F.col("line") + 1).alias("line_number"), F.posexplode(F.transform(F.split("text", r"(?U)(?<=[.;])\s+"), strip)).alias("ord", "sentence"))
    rows = parts.where(F.char_length("sentence") >= 10).withColumn("lower", F.lower("sentence"))
    # from an outer generator the filter is not pushed below, where the tests would be made once more
    found = rows.select(*parts.columns, F.explode_outer(F.array(keyword(F.col("sentence"), F.col("lower")))).alias("keyword"))
    return found.where("keyword IS NOT NULL")


def priority_top(found: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` of a document by keyword priority, then text order."""
    rank = F.coalesce(*[F.when(F.col("keyword") == k, i) for i, k in enumerate(PRIORITY)])
    w = Window.partitionBy("doc_id").orderBy("priority", "line_number", "ord")
    return found.withColumn("priority", rank).where("priority IS NOT NULL").withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)


def keyword_top(found: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("doc_id", "keyword").orderBy("line_number", "ord")
    of = Window.partitionBy("doc_id", "keyword")
    return found.withColumns({"n": F.row_number().over(w), "of": F.count(F.lit(1)).over(of)}).where(F.col("n") <= n)


def _squeezed(text: str) -> str:
    return " ".join(text.split()).lower()


#: Widths of windows, as shares of the quote's.
WINDOW_SIZES = (1.0, 1.2, 0.8)


def fuzzy_match(source: str | None, text: str, hay: Haystack | None = None, window: tuple[float, int, int] | None = None) -> tuple[float, str | None]:
    """(ratio, the text's best window): 1 if the normalised text holds the source, which
    one of white space alone always is; an empty one is not looked for. ``hay`` may give
    the text in its normal form, ``window`` its best one."""
    if not source:
        return 0.0, None
    hay = hay or Haystack(_squeezed(text))
    needle = _squeezed(source)
    if needle in hay.text:
        return 1.0, source
    score, at, size = best_window(needle, hay, WINDOW_SIZES, clamp=False) if window is None else window
    return (score, text[at : at + size]) if at >= 0 else (0.0, None)


def exact_quotes(items: DataFrame, docs: DataFrame) -> DataFrame:
    """``items`` (doc_id, ord, item_id, item_type, source_text) with match_ratio and
    best_match_text where no search is needed: an empty quote has 0, one that the
    normalised text holds 1; null elsewhere."""
    d = docs.select("doc_id", audit_norm(F.col("raw_text")).alias("doc_norm"))
    rows = items.join(d, "doc_id", "left")
    empty = F.coalesce("source_text", F.lit("")) == ""
    held = F.contains(F.coalesce("doc_norm", F.lit("")), audit_norm(F.col("source_text")))
    ratio = F.when(empty, 0.0).when(held, 1.0)
    return rows.select("doc_id", F.col("ord").cast("int").alias("ord"), "item_id", "item_type", "source_text", ratio.alias("match_ratio"), F.when(~empty & held, F.col("source_text")).alias("best_match_text"))


def _open(text: str | None) -> tuple[str, Haystack]:
    return text or "", Haystack(_squeezed(text or ""))


def _match_all(asked: list[tuple[tuple[str, Haystack], dict]], least: float = 0.0) -> list[tuple]:
    """fuzzy_match() of each item in its document; (0, None) where the bounds of all windows
    are below ``least``."""
    needles = [_squeezed(item["source_text"] or "") for _, item in asked]
    hard = [k for k, ((_, hay), _) in enumerate(asked) if needles[k] not in hay.text]
    windows = dict(zip(hard, best_windows([(needles[k], asked[k][0][1]) for k in hard], WINDOW_SIZES, clamp=False, least=least)))
    return [fuzzy_match(item["source_text"], text, hay, windows.get(k)) for k, ((text, hay), item) in enumerate(asked)]


def verify_quotes(items: DataFrame, docs: DataFrame, threshold: float = 0.85, store: str | None = None) -> DataFrame:
    """exact_quotes() with the search done where it is needed, and a status.

    Quotes that need it go beside their document, which is sent once for all of them; with
    a path ``store``, exact_quotes() is written there once and read back.
    """
    rows = stored(exact_quotes(items, docs), store)
    hard = rows.where("match_ratio IS NULL").drop("match_ratio", "best_match_text")
    found = beside_documents(hard, docs, _open, "match_ratio double, best_match_text string", together=_match_all)
    return rows.where("match_ratio IS NOT NULL").unionByName(found).withColumn("status", audit_status(F.col("match_ratio"), threshold))


def quote_statuses(items: DataFrame, docs: DataFrame, threshold: float = 0.85, store: str | None = None) -> DataFrame:
    """(doc_id, ord, item_type, status) as of verify_quotes(), without ratios and texts: no
    ratio is taken in a document whose windows' bounds all tell that a quote is flagged."""
    rows = exact_quotes(items, docs).select("doc_id", "ord", "item_type", F.when(F.col("match_ratio").isNull(), F.col("source_text")).alias("source_text"), "match_ratio")
    rows = stored(rows, store)
    hard = rows.where("match_ratio IS NULL").drop("match_ratio")
    found = beside_documents(hard, docs, _open, "match_ratio double, best_match_text string", together=partial(_match_all, least=min(threshold, EXACT)))
    both = rows.where("match_ratio IS NOT NULL").unionByName(found.drop("best_match_text"))
    return both.select("doc_id", "ord", "item_type", audit_status(F.col("match_ratio"), threshold).alias("status"))


#: From this ratio on a quote counts as verified.
EXACT = 0.95


def audit_status(score: Column, threshold: float = 0.85) -> Column:
    return F.when(score >= EXACT, "VERIFIED").when(score >= threshold, "LIKELY_OK").otherwise("FLAGGED")


def audit_items(obligations: DataFrame, flags: DataFrame) -> DataFrame:
    """Obligations, then risk flags, as items with their ids."""
    a = obligations.select("doc_id", F.col("ord").cast("int").alias("ord"), F.coalesce("id", F.lit("UNKNOWN")).alias("item_id"), F.lit("obligation").alias("item_type"), "source_text")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "set_ord"))
    b = flags.select("doc_id", n.cast("int").alias("ord"), F.format_string("FLAG-%03d", n).alias("item_id"), F.lit("risk_flag").alias("item_type"), "source_text")
    return a.unionByName(b)


def _open_quotes(quotes: list[str] | None):
    others = list(dict.fromkeys(_squeezed(q) for q in quotes or []))
    known: dict[str, float] = {}

    def answer(item: dict) -> tuple:
        a = _squeezed(item["sentence"])
        if a not in known:
            best = 1.0 if a and a in others else 0.0
            if best < 1.0:
                for most, q in sorted(((ratio_bound(a, q), q) for q in others), reverse=True):
                    if most <= best:
                        break
                    best = max(best, ratio_from(a, q, best))
            known[a] = best
        return (known[a],)

    return answer


_known = Ratios()


def _others(quotes: list[str] | None) -> list[str]:
    return list(dict.fromkeys(map(_squeezed, quotes or [])))


def _likeness(asked: list[tuple[list[str], dict]], enough: float) -> list[tuple]:
    """(ratio,) of each sentence to the quote most like it, worked out for all together; a
    sentence with a quote of ``enough`` may have less than its best."""
    rows, tried = [], []
    for others, item in asked:
        a = _squeezed(item["sentence"])
        best, rest = (1.0, []) if a in others else (0.0, [q for q in others if a and q])
        for q in rest:
            if (x := _known.get((a, q))) is not None and x > best:
                best = x
        rows.append([a, best])
        tried.append([] if best >= enough else [(a, q) for q in rest if 2.0 * min(len(a), len(q)) / (len(a) + len(q)) > best])
    got = _known.learn([pair for pairs in tried for pair in pairs])
    return [(max([best, *(got[p] for p in pairs)]),) for (_, best), pairs in zip(rows, tried)]


def potential_misses(found: DataFrame, items: DataFrame, threshold: float = 0.7, store: str | None = None) -> DataFrame:
    """Keyword sentences unlike every quote of their document: an anti-join by similarity.

    A document's quotes are sent once for all of its sentences. A sentence that one quote
    is like is not compared further, pairs that recur are compared once, and what is left
    of many documents is compared together. Sentences are counted, then sent: with a path
    ``store`` they are written there once and read back."""
    found = stored(found, store)
    quotes = items.where(F.coalesce("source_text", F.lit("")) != "").groupBy("doc_id").agg(F.collect_set("source_text").alias("quotes"))
    rows = beside_documents(found, quotes, _others, "similarity_to_existing double", text="quotes", order="line_number", together=partial(_likeness, enough=threshold))
    return rows.where(F.col("similarity_to_existing") < threshold)


def status_tallies(results: DataFrame) -> DataFrame:
    return results.groupBy("item_type").pivot("status", ["VERIFIED", "LIKELY_OK", "FLAGGED"]).count().na.fill(0)


#: Lines of the checklist that hold no result, part by part; fixed values.
CHECKLIST = {
    "head": ["**Audited:** Not yet", "**Audit Date:** -", "**Time Spent:** -", "**Auditor:** -", "", "---", "", "## Verified", "", "_Mark each obligation/risk as you verify it against the source contract_", "", "### Obligations"],
    "flags": ["", "### Risk Flags"],
    "issues": ["", "---", "", "## Issues Found", "", "_Document any problems with the ground truth annotations_", "", "| ID | Issue | Resolution |", "|----|-------|------------|", "| - | - | - |", "", "---", "", "## Missed by AI", "", "_Obligations or risks present in contract but not captured by system_", "", "| Section | Description | Suggested Obligation/Risk |", "|---------|-------------|---------------------------|"],
    "wrong": ["", "---", "", "## Hallucinated (Remove)", "", "_Items AI extracted that don't exist or are incorrect_", "", "| System ID | Issue | Action |", "|-----------|-------|--------|"],
    "notes": ["", "---", "", "## Risk Flag Adjustments", "", "_Changes to severity or category_", "", "| Risk ID | Current | Recommended | Reason |", "|---------|---------|-------------|--------|", "| - | - | - | - |", "", "---", "", "## Notes", "", "_Additional observations for lessons learned_", ""],
}


def render_checklist(results: DataFrame, misses: DataFrame, names: DataFrame, shown: int = 10, today: Column | None = None) -> DataFrame:
    """(doc_id, markdown) for each document of ``names`` (doc_id, name): every item with a
    box, the first ``shown`` potential misses by keyword priority, the flagged items, and
    the counts. ``results`` may have description, and severity for risk flags."""
    for c in ("description", "severity"):
        results = results if c in results.columns else results.withColumn(c, F.lit(""))
    fixed = lambda part: F.array(*[F.lit(x) for x in CHECKLIST[part]])
    empty, dash = F.array().cast("array<string>"), F.array(F.lit("| - | - | - |"))
    box = F.when(F.col("status") == "VERIFIED", "[X]").when(F.col("status") == "LIKELY_OK", "[LIKELY]").otherwise("[FLAG]")
    own = F.when(F.col("item_type") == "obligation", F.col("item_id")).otherwise(F.format_string("RISK-%03d", "ord"))
    line = F.concat(F.lit("- "), box, F.lit(" "), own, F.lit(": "), F.coalesce("description", F.lit("")), F.when((F.col("item_type") == "risk_flag") & (F.upper(F.coalesce("severity", F.lit(""))) == "HIGH"), " (HIGH)").otherwise(""))
    wrong = F.when(F.col("status") == "FLAGGED", F.concat(F.lit("| "), "item_id", F.format_string(" | Only %.0f%% match - verify source text | Review |", F.bround(F.col("match_ratio") * 100))))
    row = F.struct("item_type", "ord", "status", line.alias("line"), wrong.alias("wrong"))
    items = results.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("items"))
    cell = F.concat(F.lit("| Line "), "line_number", F.lit(" | "), truncate(F.col("sentence"), 60), F.lit(" | Review: contains '"), F.lower("keyword"), F.lit("' |"))
    top = priority_top(misses, shown).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", cell.alias("line")))).alias("top"))
    n = misses.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_missed"))
    rows = names.join(items, "doc_id", "left").join(top, "doc_id", "left").join(n, "doc_id", "left")
    of = lambda kind: F.coalesce(F.filter("items", lambda x: x["item_type"] == kind), F.filter(F.from_json(F.lit("[]"), items.schema["items"].dataType), lambda x: F.lit(True)))
    lines = lambda xs: F.transform(xs, lambda x: x["line"])
    flagged = F.array_compact(F.concat(F.transform(of("obligation"), lambda x: x["wrong"]), F.transform(of("risk_flag"), lambda x: x["wrong"])))
    count = lambda xs, status: F.size(F.filter(xs, lambda x: x["status"] == status))
    tally = lambda kind, word: F.format_string(f"- %d {word} verified: %d exact, %d likely, %d flagged", F.size(of(kind)), *[count(of(kind), s) for s in ("VERIFIED", "LIKELY_OK", "FLAGGED")])
    day = F.date_format(F.current_date() if today is None else today, "yyyy-MM-dd")
    whole = F.concat(
        F.array(F.concat(F.lit("# Audit: "), "name"), F.lit("")), fixed("head"), lines(of("obligation")), fixed("flags"), lines(of("risk_flag")), fixed("issues"), F.coalesce(lines(F.col("top")), dash),
        fixed("wrong"), F.when(F.size(flagged) > 0, flagged).otherwise(dash), fixed("notes"),
        F.array(F.concat(F.lit("- Auto-generated on "), day), tally("obligation", "obligations"), tally("risk_flag", "risk flags"), F.format_string("- %d potential missed clauses found for review", F.coalesce("n_missed", F.lit(0))), F.lit("")),
        empty,
    )
    return rows.select("doc_id", F.array_join(whole, "\n").alias("markdown"))


#: Labels of the console's lines; fixed values.
STATUS_LABELS = {"VERIFIED": ("OK", "VERIFIED", ""), "LIKELY_OK": ("~", "LIKELY OK", ""), "FLAGGED": ("X", "FLAGGED", " <- NEEDS REVIEW")}
ITEM_HEADS = {"obligation": "SOURCE TEXT VERIFICATION (%d obligations)", "risk_flag": "RISK FLAG VERIFICATION (%d flags)"}
COUNTS = "  Summary: %d verified, %d likely ok, %d flagged"
MISSED_HEAD = ["POTENTIALLY MISSED CLAUSES (%d found)", "  Review these sentences - they contain obligation keywords but aren't in ground truth:"]
NONE_MISSED = "POTENTIALLY MISSED CLAUSES: None found"


def console_lines(results: DataFrame, misses: DataFrame) -> DataFrame:
    """(doc_id, text) of each document with items: every item with a mark and its match,
    obligations with the start of their quote, counts for each kind of item, then three
    potential misses of each keyword."""
    line = None
    for status, (mark, word, more) in STATUS_LABELS.items():
        text = F.concat(F.lit(f"  {mark} "), "item_id", F.lit(f": {word} ("), F.format_string("%.1f%% match)", F.col("match_ratio") * 100), F.lit(more))
        line = F.when(F.col("status") == status, text) if line is None else line.when(F.col("status") == status, text)
    quote = F.concat(F.lit('     "'), truncate(F.coalesce("source_text", F.lit("")), 60), F.lit('"'))
    both = F.concat_ws("\n", line, F.when(F.col("item_type") == "obligation", quote))
    count = lambda status: F.count_if(F.col("status") == status)
    kinds = results.groupBy("doc_id", "item_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", both.alias("line")))), lambda x: x["line"]).alias("lines"), F.format_string(COUNTS, *map(count, STATUS_LABELS)).alias("counts"))
    head = F.when(F.col("item_type") == "obligation", F.format_string(ITEM_HEADS["obligation"], F.size("lines"))).otherwise(F.format_string(ITEM_HEADS["risk_flag"], F.size("lines")))
    blocks = kinds.select("doc_id", F.lit(0).alias("part"), F.col("item_type").alias("name"), F.concat_ws("\n", head, "lines", "counts", F.lit("")).alias("block"))
    n = misses.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_missed"))
    heads = results.select("doc_id").distinct().join(n, "doc_id", "left").select("doc_id", F.lit(1).alias("part"), F.lit("").alias("name"), F.when(F.col("n_missed") > 0, F.concat_ws("\n", F.format_string(MISSED_HEAD[0], "n_missed"), F.lit(MISSED_HEAD[1]))).otherwise(NONE_MISSED).alias("block"))
    shown = F.concat(F.format_string("    Line %d: \"", "line_number"), truncate(F.col("sentence"), 70), F.lit('"'))
    by_word = keyword_top(misses).groupBy("doc_id", "keyword").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", shown.alias("line")))), lambda x: x["line"]).alias("lines"), F.max("of").alias("of"))
    more = F.when(F.col("of") > 3, F.format_string("    ... and %d more", F.col("of") - 3))
    missed = by_word.select("doc_id", F.lit(2).alias("part"), F.col("keyword").alias("name"), F.concat_ws("\n", F.concat(F.lit("  ["), "keyword", F.lit("]")), "lines", more).alias("block"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "name", "block"))), lambda x: x["block"])
    return blocks.unionByName(heads).unionByName(missed).groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("text"))
