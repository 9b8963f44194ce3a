"""Evaluation against annotations: greedy matching, precision, recall, F1, metadata."""

from __future__ import annotations

from collections import Counter
from collections.abc import Generator, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Ratios, ratio_bound, ratio_from, similarity_udf
from .report import percent

OBLIGATION, RISK = (0.6, 0.85), (0.5, 0.8)


def _same(a, b, other: float) -> float:
    return 1.0 if (a or "").lower() == (b or "").lower() else other


def obligation_parts(s, t):
    """The weights of the texts whose similarity counts, and the score that these make."""
    same = 0.15 * _same(s["party"], t["party"], 0.0), 0.1 * _same(s["type"], t["type"], 0.5)
    return [(0.5, "source_text"), (0.25, "description")], lambda text, other: text + other + same[0] + same[1]


def risk_parts(s, t):
    same = 0.3 * (s["category"] == t["category"]) + 0.15 * (1.0 if s["severity"] == t["severity"] else 0.5)
    return [(0.3, "source_text"), (0.25, "title")], lambda text, title: same + text + title


def obligation_score(s, t, above: float = -1.0) -> float:
    return _weighed(s, t, *obligation_parts(s, t), above)


def risk_score(s, t, above: float = -1.0) -> float:
    return _weighed(s, t, *risk_parts(s, t), above)


@lru_cache(8192)
def _plain(text: str) -> str:
    return text.lower().strip()


@lru_cache(8192)
def _prepared(text: str) -> tuple[str, Counter]:
    return _plain(text), Counter(_plain(text))


def _bound(a: str | None, b: str | None) -> float:
    """At least their similarity: by the characters in common, order left out."""
    if not a or not b:
        return 0.0
    (x, m), (y, n) = _prepared(a), _prepared(b)
    if x == y:
        return 1.0
    few, many = (m, n) if len(m) < len(n) else (n, m)
    return 2.0 * sum(min(k, many[c]) for c, k in few.items() if c in many) / (len(x) + len(y))


def _similar(a: str | None, b: str | None, least: float) -> float:
    """The similarity; a negative number where it is below ``least``."""
    if not a or not b:
        return 0.0
    x, y = _prepared(a)[0], _prepared(b)[0]
    if x == y:
        return 1.0
    return -1.0 if least > 0 and ratio_bound(x, y) < least else ratio_from(x, y, least)


def _weighed(s, t, texts: list[tuple[float, str]], total, above: float) -> float:
    """The total of weighed similarities; -1 where it cannot exceed ``above``, which
    bounds of the similarities may show before these are taken."""
    parts = [w * _bound(s[c], t[c]) for w, c in texts]
    for k, (w, c) in enumerate(texts):
        most = total(*parts)
        if most <= above:
            return -1.0
        got = _similar(s[c], t[c], (above - most + parts[k]) / w - 1e-9)
        if got < 0:
            return -1.0
        parts[k] = w * got
    return total(*parts)


_known = Ratios()


def _matches(mine: list[dict], others: list[dict], parts, threshold: float) -> Generator[list[tuple[str, str]], dict[tuple[str, str], float], list[tuple]]:
    """(ord, truth_ord, score, whether one is taken) of a document's rows, in order. Yields the pairs of texts
    whose ratios it needs next and is sent these, so that many documents ask together."""
    left = {i: x for i, x in enumerate(others)}
    out = []
    for one in mine:
        asked = []
        for i, other in left.items():
            weights, total = parts(one["row"], other["row"])
            pairs, sure = [], []
            for w, c in weights:
                a, b = one["row"][c], other["row"][c]
                pair = None
                if not a or not b:
                    x = 0.0
                elif a == b or (pair := (_plain(a), _plain(b)))[0] == pair[1]:
                    x, pair = 1.0, None
                elif not pair[0] or not pair[1]:
                    x, pair = 0.0, None
                elif (x := _known.get(pair)) is None:
                    x = 2.0 * min(map(len, pair)) / sum(map(len, pair))
                else:
                    pair = None
                pairs.append((w, pair))
                sure.append(w * x)
            asked.append([total(*sure), i, pairs, sure, total])
        while True:
            best = max((x[0] for x in asked if not any(p for _, p in x[2])), default=0.0)
            need = [x for x in asked if x[0] >= best and any(p for _, p in x[2])]
            if not need:
                break
            # first texts settle most; then one pair after another, the most hopeful first
            first = [x for x in need if x[2][0][1]]
            need, k = (first, 0) if first else ([max(need, key=lambda x: x[0])], 1)
            got = yield [x[2][k][1] for x in need]
            for x in need:
                w, pair = x[2][k]
                x[2][k], x[3][k] = (w, None), w * got[pair]
                x[0] = x[4](*x[3])
        best, at = 0.0, None
        for score, i, pairs, _, _ in asked:
            if score > best and not any(p for _, p in pairs):
                best, at = score, i
        taken = left.pop(at) if at is not None and best >= threshold else None
        out.append((one["ord"], taken and taken["ord"], best, taken is not None))
    return out


def _together(running: list[Generator]) -> list[list[tuple]]:
    """The results of all, each step's ratios worked out together."""
    out: list = [None] * len(running)
    asked: dict[int, list] = {}

    def go(k: int, got) -> None:
        try:
            asked[k] = running[k].send(got)
        except StopIteration as end:
            out[k] = end.value

    for k in range(len(running)):
        go(k, None)
    while asked:
        now, known = list(asked), _known.learn([p for pairs in asked.values() for p in pairs])
        asked.clear()
        for k in now:
            go(k, known)
    return out


def _rows(lists: pa.ListArray) -> list[list[dict]]:
    """Lists of (ord, row), column by column: much faster than one value after another."""
    place, row = lists.flatten().flatten()
    names = [f.name for f in row.type]
    values = [{"ord": k, "row": dict(zip(names, x))} for k, x in zip(place.to_pylist(), zip(*[c.to_pylist() for c in row.flatten()]))]
    ends = accumulate(n or 0 for n in lists.value_lengths().to_pylist())
    at = 0
    return [values[at : (at := end)] for end in ends]


#: Documents that are matched together.
TOGETHER = 8192


def match_greedy(system: DataFrame, truth: DataFrame, parts=obligation_parts, threshold: float = 0.6, exact: float = 0.85) -> DataFrame:
    """(doc_id, ord, truth_ord, score, match_type), for each system row in order the best
    annotation not yet taken. Later rows depend on earlier ones, so a document's rows
    are matched in one place, as two lists; documents are independent, and dealt over all
    tasks, as the work is in seconds and not in bytes. Similarities are worked out for many
    documents together, where bounds leave a pair a chance."""
    kind = system.schema["doc_id"].dataType.simpleString()
    rows = lambda df, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*[c for c in df.columns if c != "doc_id"]).alias("row")))).alias(name))
    tasks = int(system.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = rows(system, "mine").join(rows(truth, "others"), "doc_id", "left").repartition(tasks, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, TOGETHER) for k in range(0, whole.num_rows, TOGETHER)):
                found = _together([_matches(mine, others, parts, threshold) for mine, others in zip(_rows(b.column(1)), _rows(b.column(2)))])
                out = [(k, place, other, best, "none" if not taken else "exact" if best >= exact else "partial") for k, rows in enumerate(found) for place, other, best, taken in rows]
                k, place, other, best, how = (list(c) for c in zip(*out)) if out else ([],) * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(k, pa.int64())), pa.array(place, pa.int32()), pa.array(other, pa.int32()), pa.array(best, pa.float64()), pa.array(how, pa.string())], names=["doc_id", "ord", "truth_ord", "score", "match_type"])

    return both.mapInArrow(run, f"doc_id {kind}, ord int, truth_ord int, score double, match_type string")


def match_by_score(scores: DataFrame, threshold: float) -> DataFrame:
    """The same on ready scores (doc_id, ord, truth_ord, score), as a fold in SQL."""
    rows = scores.groupBy("doc_id", "ord").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "truth_ord"))).alias("options"))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "options"))).alias("rows"))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<ord:int,truth_ord:int,score:double>>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        best = F.get(F.filter(r["options"], lambda o: ~F.array_contains(s["used"], o["truth_ord"]) & (-o["minus"] >= threshold)), 0)
        row = F.struct(r["ord"].alias("ord"), best["truth_ord"].alias("truth_ord"), (-best["minus"]).alias("score"))
        return F.struct(F.when(best.isNull(), s["used"]).otherwise(F.array_append(s["used"], best["truth_ord"])).alias("used"), F.array_append(s["out"], row).alias("out"))

    return docs.select("doc_id", F.explode(F.aggregate("rows", start, step, lambda s: s["out"])).alias("m")).select("doc_id", "m.*")


def prf(matched: Column, system: Column, truth: Column) -> dict[str, Column]:
    """precision, recall and f1, each 0 where its denominator is."""
    p = F.coalesce(F.try_divide(matched, system), F.lit(0.0))
    r = F.coalesce(F.try_divide(matched, truth), F.lit(0.0))
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}


def metrics(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """(doc_id, tp, fp, fn, precision, recall, f1)."""
    m = matches.groupBy("doc_id").agg(F.count("truth_ord").alias("tp"), F.count_if(F.col("truth_ord").isNull()).alias("fp"))
    t = truth.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_truth"))
    rows = m.join(t, "doc_id", "full").na.fill(0, ["tp", "fp", "n_truth"]).withColumn("fn", F.col("n_truth") - F.col("tp"))
    return rows.withColumns(prf(F.col("tp"), F.col("tp") + F.col("fp"), F.col("n_truth"))).drop("n_truth")


def party_sets(system: DataFrame, truth: DataFrame) -> DataFrame:
    """(doc_id, matched, extra, missing): sorted lower-case names of both sides."""
    side = lambda df, name: df.groupBy("doc_id").agg(F.collect_set(F.lower("name")).alias(name))
    none = F.array().cast("array<string>")
    rows = side(system, "s").join(side(truth, "t"), "doc_id", "full").select("doc_id", F.coalesce("s", none).alias("s"), F.coalesce("t", none).alias("t"))
    return rows.select("doc_id", F.array_sort(F.array_intersect("s", "t")).alias("matched"), F.array_sort(F.array_except("s", "t")).alias("extra"), F.array_sort(F.array_except("t", "s")).alias("missing"))


def metadata_accuracy(system: DataFrame, truth: DataFrame, fields: tuple[str, ...] = ("effective_date", "term", "termination_notice_period")) -> DataFrame:
    """(doc_id, field, match, system, ground_truth): both null, or neither null nor empty
    and similar. Where both sides have ``auto_renewal``, auto_renewal_exists matches if it
    is equal."""
    long = lambda df, v: df.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias(v)) for f in fields])).alias("x")).select("doc_id", "x.*")
    rows = long(system, "system").join(long(truth, "ground_truth"), ["doc_id", "field"])
    there = (F.col("system") != "") & (F.col("ground_truth") != "")
    match = F.when(F.col("system").isNull() & F.col("ground_truth").isNull(), True).when(there, similarity_udf("system", "ground_truth") > 0.8).otherwise(False)
    out = rows.select("doc_id", "field", match.alias("match"), "system", "ground_truth")
    if "auto_renewal" in system.columns and "auto_renewal" in truth.columns:
        of = lambda df, v: df.select("doc_id", F.col("auto_renewal.exists").cast("string").alias(v))
        exists = of(system, "system").join(of(truth, "ground_truth"), "doc_id")
        out = out.unionByName(exists.select("doc_id", F.lit("auto_renewal_exists").alias("field"), F.col("system").eqNullSafe(F.col("ground_truth")).alias("match"), "system", "ground_truth"))
    return out


def macro(obligations: DataFrame, risks: DataFrame) -> DataFrame:
    """Means over documents of both F1 and of their mean."""
    rows = obligations.select("doc_id", F.col("f1").alias("o")).join(risks.select("doc_id", F.col("f1").alias("r")), "doc_id")
    return rows.agg(F.avg("o").alias("obligation_f1"), F.avg("r").alias("risk_f1"), F.avg((F.col("o") + F.col("r")) / 2).alias("overall_f1"))


def match_obligations(system: DataFrame, truth: DataFrame) -> DataFrame:
    """match_greedy() of obligations with the ids of both and a line of details."""
    scored = lambda df: df.select("doc_id", "ord", "party", "type", "description", "source_text")
    found = match_greedy(scored(system), scored(truth), obligation_parts, *OBLIGATION)
    ids = lambda df, place, name: df.select("doc_id", F.col("ord").alias(place), F.col("id").alias(name))
    rows = found.join(ids(system, "ord", "system_id"), ["doc_id", "ord"]).join(ids(truth, "truth_ord", "truth_id"), ["doc_id", "truth_ord"], "left")
    text = F.when(F.col("truth_ord").isNull(), F.format_string("No match found (best score: %.2f)", "score")).otherwise(F.format_string("Matched to %s (score: %.2f)", "truth_id", "score"))
    return rows.withColumn("details", text).select("doc_id", "ord", "truth_ord", "score", "match_type", "system_id", "truth_id", "details")


def match_risks(system: DataFrame, truth: DataFrame) -> DataFrame:
    """The same for risk flags (doc_id, ord, category, severity, title, source_text),
    numbered from 1 in each document; flags of one obligation go by ``set_ord``."""

    def placed(df: DataFrame) -> DataFrame:
        order = [c for c in ("ord", "set_ord") if c in df.columns]
        return df.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)).alias("ord"), "category", "severity", "title", "source_text")

    system, truth = placed(system), placed(truth)
    found = match_greedy(system, truth, risk_parts, *RISK)
    of = lambda df, place, name: df.select("doc_id", F.col("ord").alias(place), F.coalesce("category", F.lit("None")).alias(name))
    rows = found.join(of(system, "ord", "mine"), ["doc_id", "ord"]).join(of(truth, "truth_ord", "other"), ["doc_id", "truth_ord"], "left")
    text = F.when(F.col("truth_ord").isNull(), F.format_string("No match (category: %s)", "mine")).otherwise(F.format_string("Category: %s -> %s", "mine", "other"))
    truth_id = F.when(F.col("truth_ord").isNotNull(), F.format_string("GT-RISK-%d", "truth_ord"))
    return rows.select("doc_id", "ord", "truth_ord", "score", "match_type", F.format_string("RISK-%d", "ord").alias("system_id"), truth_id.alias("truth_id"), text.alias("details"))


def unmatched_lines(matches: DataFrame, first: int = 5) -> DataFrame:
    """(doc_id, n, line): the first unmatched rows of each document, then how many more."""
    w = Window.partitionBy("doc_id")
    rows = matches.where("match_type = 'none'").withColumns({"n": F.row_number().over(w.orderBy("ord")), "of": F.count(F.lit(1)).over(w)}).where(F.col("n") <= first + 1)
    line = F.when(F.col("n") <= first, F.concat("system_id", F.lit(": "), "details")).otherwise(F.format_string("... and %d more", F.col("of") - first))
    return rows.select("doc_id", "n", line.alias("line"))


def evaluation_report(obligations: tuple[DataFrame, DataFrame], risks: tuple[DataFrame, DataFrame], parties: tuple[DataFrame, DataFrame], headers: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row a document that has annotations, each argument (found, annotated): metrics
    and matches of obligations and risk flags, metrics of parties, accuracy of metadata,
    the unmatched obligations, and the mean of both F1."""
    counted = lambda m, name: m.select("doc_id", F.struct("precision", "recall", F.col("f1").alias("f1_score"), F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives")).alias(name))
    listed = lambda m, name: m.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct("system_id", F.col("truth_id").alias("ground_truth_id"), "match_type", F.col("score").alias("similarity")).alias("m")))), lambda x: x["m"]).alias(name))
    o, r = match_obligations(*obligations), match_risks(*risks)
    sets = party_sets(*parties).select("doc_id", *[F.size(c).alias(c) for c in ("matched", "extra", "missing")])
    of_sets = sets.withColumns(prf(F.col("matched"), F.col("matched") + F.col("extra"), F.col("matched") + F.col("missing")))
    fields = metadata_accuracy(*headers).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("match", "system", "ground_truth").alias("found"))))).alias("metadata_accuracy"))
    lines = unmatched_lines(o).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("unmatched"))
    out = headers[1].select("doc_id")
    for part in (counted(metrics(o, obligations[1]), "obligations"), counted(metrics(r, risks[1]), "risk_flags"), of_sets.select("doc_id", F.struct("precision", "recall", F.col("f1").alias("f1_score")).alias("parties")), fields, listed(o, "obligation_matches"), listed(r, "risk_matches"), lines):
        out = out.join(part, "doc_id", "left")
    none = {c: F.coalesce(c, F.from_json(F.lit('{"precision": 0, "recall": 0, "f1_score": 0, "true_positives": 0, "false_positives": 0, "false_negatives": 0}'), out.schema[c].dataType)) for c in ("obligations", "risk_flags", "parties")}
    lists = {c: F.coalesce(c, F.from_json(F.lit("[]"), out.schema[c].dataType)) for c in ("obligation_matches", "risk_matches", "unmatched")}
    return out.withColumns(none | lists).withColumn("overall_f1", (F.col("obligations.f1_score") + F.col("risk_flags.f1_score")) / 2)


def evaluation_json(reports: DataFrame) -> DataFrame:
    """(doc_id, json): one object a document; the key names are fixed values."""
    cols = ["obligations", "risk_flags", "parties", "metadata_accuracy", "obligation_matches", "risk_matches"]
    return reports.select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("contract_file"), *cols), {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


#: Labels of the evaluation's text; fixed values.
FULL_RULE, PART_RULE = "=" * 60, "-" * 40


def evaluation_text(reports: DataFrame) -> DataFrame:
    """(doc_id, text): the evaluation for reading."""
    share = lambda c: percent(F.col(c), 1)
    lit = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    line = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])

    def part(name: str, title: str, counts: bool) -> Column:
        of = lambda c: F.col(f"{name}.{c}")
        whole = lambda c: line(" (", of("true_positives"), "/", of("true_positives") + of(c), ")") if counts else F.lit("")
        return lit(title, PART_RULE, line("  Precision: ", share(f"{name}.precision"), whole("false_positives")), line("  Recall:    ", share(f"{name}.recall"), whole("false_negatives")))

    got = F.col("obligations")
    more = lit(line("  F1 Score:  ", share("obligations.f1_score")), line("  True Positives:  ", got["true_positives"]), line("  False Positives: ", got["false_positives"], " (system extracted, not in ground truth)"), line("  False Negatives: ", got["false_negatives"], " (missed by system)"), "")
    said = lambda v: F.coalesce(v, F.lit("None"))
    entry = lambda e: F.when(e["value"]["match"], lit(line("  ", e["key"], ": OK"))).otherwise(lit(line("  ", e["key"], ": MISMATCH"), line("    System: ", said(e["value"]["system"])), line("    Ground Truth: ", said(e["value"]["ground_truth"]))))
    unmatched = F.when(F.size("unmatched") > 0, F.concat(lit("UNMATCHED SYSTEM OBLIGATIONS (possible false positives)", PART_RULE), F.transform("unmatched", lambda x: line("  ", x)), lit(""))).otherwise(F.array().cast("array<string>"))
    name = F.regexp_extract(F.col("doc_id").cast("string"), r"([^/]*)/?$", 1)
    lines = F.concat(
        lit(FULL_RULE, "EVALUATION REPORT", FULL_RULE, line("Contract: ", name), ""),
        part("obligations", "OBLIGATIONS", True), more,
        part("risk_flags", "RISK FLAGS", True), lit(line("  F1 Score:  ", share("risk_flags.f1_score")), ""),
        part("parties", "PARTIES", False), lit("", "METADATA ACCURACY", PART_RULE),
        F.flatten(F.transform(F.map_entries("metadata_accuracy"), entry)), lit(""), unmatched,
        lit(FULL_RULE, line("OVERALL F1 SCORE: ", share("overall_f1")), FULL_RULE),
    )
    return reports.select("doc_id", F.array_join(lines, "\n").alias("text"))


def write_evaluation(reports: DataFrame, path: str) -> None:
    """A JSON line for each document; absent values are written as null."""
    reports.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def evaluate(system: DataFrame, truth: DataFrame) -> DataFrame:
    return metrics(match_greedy(system, truth), truth)
