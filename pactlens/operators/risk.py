"""Rule-based risk: the first matching rule of each category flags an obligation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.needed import matches

#: category: (severity, action, negotiation, explanation, rules as (pattern, title)); fixed values, in order.
RULES = {
    "financial_exposure": ("high", "Review financial exposure limits. Consider negotiating caps on liability.", "Request liability caps equal to contract value or insurance limits.", "This could expose you to significant financial liability. The obligation requires: ", [
        (r"unlimited\s+liab", "Unlimited liability exposure"),
        (r"without\s+(?:any\s+)?limit", "Uncapped financial exposure"),
        (r"shall\s+indemnify.*(?:any\s+and\s+all|all\s+claims)", "Broad indemnification"),
        (r"liquidated\s+damages", "Liquidated damages clause"),
        (r"personal(?:ly)?\s+guarant", "Personal guarantee required"),
        (r"joint(?:ly)?\s+and\s+several(?:ly)?", "Joint and several liability"),
        (r"(?:penalty|penalt(?:y|ies))\s+(?:of|for|equal)", "Penalty clause"),
        (r"(?:late\s+fee|penalty).*(?:1[0-9]|[2-9][0-9])\s*%", "Excessive late fee (>10%)"),
        (r"(?:security\s+deposit|deposit).*(?:three|four|[3-9])\s*month", "Large security deposit"),
        (r"forfeit(?:ure)?.*(?:deposit|payment)", "Forfeiture of payments"),
    ]),
    "time_bomb": ("medium", "Set calendar reminders for notice deadlines. Review renewal terms.", "Request longer notice periods (60-90 days) and opt-out renewal.", "This creates a deadline-sensitive obligation that could trigger automatically. Review carefully: ", [
        (r"auto(?:matic(?:ally)?)?[\s-]*renew", "Auto-renewal clause"),
        (r"(?:shall|will)\s+(?:automatically\s+)?(?:renew|extend|continue)", "Automatic extension"),
        (r"(?:notice|notify).*(?:at\s+least\s+)?(?:[1-9]|1[0-4])\s*(?:days?|business\s+days?)\s+(?:prior|before|in\s+advance)", "Short notice period (<15 days)"),
        (r"(?:notice|notify).*(?:at\s+least\s+)?(?:1[5-9]|2[0-9])\s*(?:days?)\s+(?:prior|before)", "Notice period (15-29 days)"),
        (r"retroactive", "Retroactive terms"),
        (r"(?:cure|remedy).*(?:[1-7])\s*(?:days?|business\s+days?)", "Short cure period (<7 days)"),
        (r"evergreen", "Evergreen clause"),
        (r"(?:perpetual|indefinite)(?:ly)?", "Indefinite term"),
        (r"in\s+(?:its|their|sole)\s+discretion.*(?:terminate|cancel)", "Discretionary termination"),
    ]),
    "asymmetric_terms": ("medium", "Identify imbalanced terms and request reciprocal rights.", "Request mutual obligations or balanced termination rights.", "This creates an imbalanced obligation where one party has more rights than the other: ", [
        (r"(?:may|reserves?\s+the\s+right\s+to)\s+(?:modify|amend|change).*(?:at\s+any\s+time|without\s+(?:prior\s+)?notice)", "Unilateral amendment right"),
        (r"(?:in\s+(?:its|their|sole)\s+discretion)", "Sole discretion clause"),
        (r"(?:may|can)\s+(?:terminate|cancel).*(?:for\s+(?:any|no)\s+reason|at\s+(?:any\s+)?(?:time|will))", "One-sided termination right"),
        (r"(?:may|reserves?\s+the\s+right\s+to)\s+increase.*(?:fee|price|rate|rent)", "Unilateral price increase"),
        (r"non-?refundable", "Non-refundable payment"),
        (r"waive.*(?:right|claim)", "Waiver of rights"),
        (r"(?:you|tenant|employee|customer)\s+(?:shall|must|agree\s+to)\s+indemnify", "One-sided indemnification"),
    ]),
    "competitive_restriction": ("high", "Carefully review scope and duration of restrictions.", "Narrow geographic scope, shorten duration, clarify permitted activities.", "This restricts your ability to work with competitors or use certain skills/knowledge: ", [
        (r"non[\s-]*compete", "Non-compete clause"),
        (r"(?:shall|agree)\s+not\s+(?:to\s+)?(?:compete|engage)", "Competition restriction"),
        (r"non[\s-]*solicit", "Non-solicitation clause"),
        (r"(?:shall|agree)\s+not\s+(?:to\s+)?(?:solicit|recruit|hire)", "Solicitation restriction"),
        (r"exclusiv(?:e|ity)", "Exclusivity requirement"),
        (r"(?:assign|transfer).*(?:all|any).*(?:intellectual\s+property|ip|invention|work\s+product)", "Broad IP assignment"),
        (r"(?:work(?:s)?\s+(?:for\s+hire|made\s+for\s+hire)|work-?for-?hire)", "Work for hire"),
        (r"(?:18|24|36)\s*months?", "Extended restriction period"),
        (r"(?:worldwide|global|anywhere)", "Worldwide geographic scope"),
        (r"(?:trade\s+secret|proprietary\s+information).*(?:perpetual|indefinite|forever)", "Perpetual trade secret obligation"),
    ]),
    "unclear_obligation": ("low", "Clarify vague terms before signing if possible.", "Request specific definitions, timelines, or objective standards.", "The obligation uses vague language that could be interpreted differently by each party: ", [
        (r"reasonable\s+efforts?", "Reasonable efforts standard"),
        (r"best\s+efforts?", "Best efforts standard"),
        (r"commercially\s+reasonable", "Commercially reasonable standard"),
        (r"as\s+(?:needed|required|necessary)", 'Undefined "as needed" obligation'),
        (r"from\s+time\s+to\s+time", "Undefined frequency"),
        (r"(?:material|substantial)(?:ly)?(?!\s+(?:all|breach))", "Undefined materiality"),
        (r"(?:to\s+(?:its|their)\s+satisfaction)", "Subjective satisfaction"),
        (r"(?:promptly|timely)(?!\s+\d)", "Undefined timeline"),
        (r"(?:adequate|sufficient|appropriate)", "Undefined adequacy"),
    ]),
    "consent_risk": ("medium", "Understand what requires approval and ensure timelines are defined.", "Add response deadlines and objective criteria for approval.", "This requires obtaining approval which could cause delays or be denied: ", [
        (r"(?:consent|approval).*(?:not\s+(?:to\s+be\s+)?unreasonably\s+(?:withheld|delayed))", "Consent standard"),
        (r"(?:prior\s+(?:written\s+)?(?:consent|approval))", "Prior approval required"),
        (r"(?:sole\s+(?:and\s+absolute\s+)?discretion)", "Sole discretion"),
        (r"(?:without\s+(?:prior\s+)?(?:consent|approval))", "No consent required"),
        (r"(?:may\s+(?:withhold|deny)\s+(?:consent|approval))", "Discretionary denial"),
    ]),
    "dispute_resolution": ("medium", "Understand dispute resolution process and venue requirements.", "Request mutual venue or mediation before arbitration.", "This affects how disputes are resolved and may limit your legal options: ", [
        (r"(?:binding\s+)?arbitration", "Mandatory arbitration"),
        (r"(?:waive|waiver).*(?:jury|trial)", "Jury trial waiver"),
        (r"class\s+action\s+waiver", "Class action waiver"),
        (r"(?:waive|waiver).*(?:class|collective|representative)", "Collective action waiver"),
        (r"(?:prevailing\s+party|loser\s+pays).*(?:attorney|legal)\s+fees?", "Loser pays provision"),
        (r"(?:exclusive\s+(?:jurisdiction|venue))", "Exclusive venue"),
        (r"(?:within\s+(?:one|1)\s+year|(?:one|1)[\s-]*year\s+(?:statute|limitation))", "Short limitation period"),
        (r"(?:six|6)\s*months?.*(?:bring|commence|file)", "Very short limitation period"),
    ]),
}
CATEGORIES = list(RULES)
#: The searched text is lower-case already.
FLAGS = "(?Ud)"


#: Rules of a table that one plan takes at most: each is a branch of it.
MOST_RULES = 2000
RULE_TABLE = "category string, category_order int, rule_order int, pattern string, title string, severity string, action string, negotiation string, explanation string"
Rules = dict[str, tuple[str, str, str, str, list[tuple[str, str]]]]


def rules_table(spark: SparkSession) -> DataFrame:
    """The built-in rules as a table, to be kept, changed and added to."""
    rows = [(c, k, i, p, title, s, action, negotiation, explains) for k, (c, (s, action, negotiation, explains, rules)) in enumerate(RULES.items()) for i, (p, title) in enumerate(rules)]
    return spark.createDataFrame(rows, RULE_TABLE)


def load_rules(table: DataFrame) -> Rules:
    """A table of rules, checked, as the plan takes it: a small configuration, MOST_RULES
    rows at most. Patterns are regular expressions over lower-case text; a category has one
    severity and one wording."""
    rows = table.select(*[c.split()[0] for c in RULE_TABLE.split(", ")]).orderBy("category_order", "category", "rule_order").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rules: Rules = {}
    for r in rows:
        if r.severity not in ("high", "medium", "low"):
            raise ValueError(f"{r.category}: no such severity: {r.severity}")
        if r.pattern is None or r.title is None or r.category is None:
            raise ValueError(f"a rule without category, pattern or title: {r}")
        said = (r.severity, r.action, r.negotiation, r.explanation or "")
        if rules.setdefault(r.category, (*said, []))[:4] != said:
            raise ValueError(f"{r.category}: its rules differ in severity or wording")
        rules[r.category][4].append((r.pattern, r.title))
    bad = [p for *_, found in rules.values() for p, _ in found if not _compiles(table.sparkSession, p)]
    if bad:
        raise ValueError(f"no regular expressions: {bad}")
    return rules


def _compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether the engine takes the pattern: a constant that the optimiser works out."""
    try:
        spark.range(1).select(F.lit("").rlike(FLAGS + pattern)).collect()
    except Exception as e:
        if "REGEX" not in str(e).upper() and "PATTERN" not in str(e).upper():
            raise
        return False
    return True


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 3).when(severity == "medium", 2).when(severity == "low", 1)


def search_text(description: str = "description", source: str = "source_text", conditions: str = "conditions") -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in (description, source, conditions)]))


def first_title(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The title of the first rule that matches; null if none does."""
    pattern, title = rules[0]
    out = F.when(matches(text, FLAGS, pattern), title)
    for pattern, title in rules[1:]:
        out = out.when(matches(text, FLAGS, pattern), title)
    return out


def rule_matches(obligations: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(doc_id, ord, category, rule): every rule that matches, not the first alone."""
    table = RULES if rules is None else load_rules(rules)
    tests = [F.when(matches(F.col("t"), FLAGS, p), F.struct(F.lit(c).alias("category"), F.lit(k).alias("rule"))) for c in table for k, (p, _) in enumerate(table[c][4])]
    # an outer generator: of another the optimiser infers a filter, which takes all tests once more
    found = obligations.select("doc_id", "ord", search_text().alias("t")).select("doc_id", "ord", F.explode_outer(F.array(*tests)).alias("m")).where("m IS NOT NULL")
    return found.select("doc_id", "ord", "m.category", "m.rule")


def score_risks(obligations: DataFrame, header: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Flags (doc_id, ord, set_ord, obligation_id, category, severity, title, description,
    source_text, source_location, action_required, negotiation_suggestion).

    One pass, no shuffle: each category is one CASE over its rules. ``header`` adds the
    flag of an automatic renewal, last in its document. ``rules`` (see RULE_TABLE) takes the
    place of the built-in ones.
    """
    table = RULES if rules is None else load_rules(rules)
    flag = []
    for k, c in enumerate(table):
        severity, action, negotiation, explains, _ = table[c]
        title = F.col(f"title_{k}")
        text = F.concat(title, F.lit(" detected. " + explains), F.coalesce("description", F.lit("None")))
        flag.append(F.when(title.isNotNull(), F.struct(F.lit(k).alias("set_ord"), F.lit(c).alias("category"), F.lit(severity).alias("severity"), title.alias("title"), text.alias("text"), F.lit(action).alias("action_required"), F.lit(negotiation).alias("negotiation_suggestion"))))
    titled = obligations.withColumn("t", search_text()).withColumns({f"title_{k}": first_title(F.col("t"), table[c][4]) for k, c in enumerate(table)})
    rows = titled.withColumn("f", F.explode_outer(F.array(*flag))).where("f IS NOT NULL")  # outer: see rule_matches()
    cols = ["f.set_ord", F.col("id").alias("obligation_id"), "f.category", "f.severity", "f.title", F.col("f.text").alias("description"), "source_text", "source_location", "f.action_required", "f.negotiation_suggestion"]
    flags = rows.select("doc_id", F.col("ord").cast("int").alias("ord"), *cols)
    return flags.unionByName(renewal_flags(header)) if header is not None else flags


def renewal_flags(header: DataFrame) -> DataFrame:
    """The flag of each document that renews itself; medium if it gives fewer than 30 days."""
    notice, period = F.col("auto_renewal.notice_to_cancel"), F.col("auto_renewal.period")
    days = F.regexp_extract(F.lower(notice), r"(\d+)\s*(?:days?|business\s+days?)", 1).try_cast("int")
    text = F.concat(F.lit("Contract automatically renews for "), F.coalesce(F.nullif(period, F.lit("")), F.lit("unspecified period")), F.lit(". Notice required to cancel: "), F.coalesce(F.nullif(notice, F.lit("")), F.lit("not specified")), F.lit("."))
    return header.where(F.col("auto_renewal.exists")).select(
        "doc_id", F.lit(2**31 - 1).alias("ord"), F.lit(0).alias("set_ord"), F.lit("AUTO-RENEWAL").alias("obligation_id"), F.lit("time_bomb").alias("category"),
        F.when(days < 30, "medium").otherwise("low").alias("severity"), F.lit("Auto-Renewal Clause").alias("title"), text.alias("description"), F.lit("").alias("source_text"),
        F.lit("See termination section").alias("source_location"), F.lit("Set calendar reminder for renewal notice deadline.").alias("action_required"), F.lit("Request opt-in renewal instead of auto-renewal.").alias("negotiation_suggestion"),
    )


def obligation_rollup(flags: DataFrame) -> DataFrame:
    """(doc_id, obligation_id, risk_level, risk_flags): highest severity, titles in order."""
    titles = F.array_sort(F.collect_list(F.struct("ord", "set_ord", "title")))
    grouped = flags.groupBy("doc_id", "obligation_id").agg(F.max_by("severity", severity_rank(F.col("severity"))).alias("risk_level"), titles.alias("s"))
    return grouped.select("doc_id", "obligation_id", "risk_level", F.transform("s", lambda x: x["title"]).alias("risk_flags"))


def risk_summary(flags: DataFrame) -> DataFrame:
    """(doc_id, high, medium, low, overall, most_concerning) of documents with flags."""
    n = {s: F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")}
    most = F.min_by(F.concat("title", F.lit(" ("), "category", F.lit(")")), F.struct(-severity_rank(F.col("severity")), "ord", "set_ord"))
    overall = F.when(F.col("high") >= 2, "high").when((F.col("high") >= 1) | (F.col("medium") >= 3), "medium").otherwise("low")
    return flags.groupBy("doc_id").agg(*n.values(), most.alias("most_concerning")).withColumn("overall", overall)


def of_severity(flags: DataFrame, severity: str) -> DataFrame:
    return flags.where(F.col("severity") == severity)


def numbered(flags: DataFrame) -> DataFrame:
    """Flags with their place in the document."""
    return flags.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "set_ord")))
