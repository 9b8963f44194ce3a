"""Operators on small hand-made inputs, and all queries against their SQL."""

import json
import os
import random
from collections import Counter
from difflib import SequenceMatcher

import duckdb
import pytest

from pactlens.functions.text import best_window, ratio, ratio_from, similarity, similarity_bound
from pactlens.operators import audit, evaluate, extract, risk, structure, verify
from pactlens.plans import analysis, queries
from pactlens.plans import audit as audit_plan
from pactlens.sources import readers
from pactlens.streaming import intake

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("line, heading", [("1. DEFINITIONS", True), ("ARTICLE IV: Fees", True), ("SECTION 2. Terms", True), ("CONFIDENTIALITY", True), ("EXHIBIT A", True), ("2.1 Payment", True), ("the parties agree", False), ("This Agreement is made", False)])
def test_headings(spark, line, heading):
    pages = spark.createDataFrame([(1, 1, line)], "doc_id int, page int, text string")
    assert bool(structure.sections(pages).count()) == structure.is_heading(line) == heading


def test_similarity_keeps_autojunk_and_order():
    assert similarity("tide", "diet") == 0.25 and similarity("diet", "tide") == 0.5
    long = "".join(chr(97 + i % 7) for i in range(285))
    assert similarity(long, long[1:]) == SequenceMatcher(None, long, long[1:]).ratio()
    assert similarity("", "x") == similarity(None, "x") == 0.0


def test_best_window_equals_full_search():
    text = "the seller delivers all goods within ten days and the buyer pays on receipt of them"
    needle = "buyer shall pay on receipt"
    best = (0.0, -1, 0)
    for m in (1.0, 1.2, 1.5, 0.8):
        w = min(int(len(needle) * m), len(text))
        for i in range(0, len(text) - w + 1, max(1, w // 4)):
            r = SequenceMatcher(None, needle, text[i : i + w]).ratio()
            if r > best[0]:
                best = (r, i, w)
    assert best_window(needle, text, (1.0, 1.2, 1.5, 0.8), True) == best


def _every_window(needle, text, sizes, clamp):
    best = (0.0, -1, 0)
    for m in sizes:
        w = min(int(len(needle) * m), len(text)) if clamp else int(len(needle) * m)
        for i in range(0, len(text) - w + 1, max(1, w // 4)) if w else ():
            r = SequenceMatcher(None, needle, text[i : i + w]).ratio()
            if r > best[0]:
                best = (r, i, w)
    return best


def test_best_window_on_random_texts():
    rng = random.Random(5)
    for _ in range(400):
        letters = rng.choice(["ab", "abc d", "abcdefgh ij"])
        needle, text = ("".join(rng.choice(letters) for _ in range(rng.randint(1, n))) for n in (25, 90))
        for sizes, clamp in (((1.0, 1.2, 1.5, 0.8), True), ((1.0, 1.2, 0.8), False)):
            assert best_window(needle, text, sizes, clamp) == _every_window(needle, text, sizes, clamp)


def test_ratio_and_bounds_on_random_texts():
    rng = random.Random(6)
    for _ in range(600):
        letters = rng.choice(["ab", "abc d", "abcdefgh ij"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 7, 40, 210]))) for _ in range(2))
        true = ratio(a, b)
        assert ratio_from(a, b, 0.0) == true and ratio_from(a, b, true) == true
        assert (x := ratio_from(a, b, rng.random())) == true or x < 0
        assert similarity_bound(a, b) >= similarity(a, b) and similarity(a, a) == (ratio(a.strip(), a.strip()) if a else 0.0)


def test_greedy_scores_pass_over_no_better_pair():
    rng = random.Random(7)
    text = lambda: rng.choice([None, "", " ", "pays rent", "pays the rent", "gives notice of rent", "Notice"])
    for _ in range(400):
        s, t = ({c: text() for c in ("source_text", "description", "title", "party", "type", "category", "severity")} for _ in range(2))
        for score in (evaluate.obligation_score, evaluate.risk_score):
            true, floor = score(s, t), rng.random()
            assert score(s, t, floor) == true if true > floor else score(s, t, floor) <= floor
        plain = 0.5 * similarity(s["source_text"], t["source_text"]) + 0.25 * similarity(s["description"], t["description"])
        plain += 0.15 * ((s["party"] or "").lower() == (t["party"] or "").lower())
        assert abs(evaluate.obligation_score(s, t) - plain - 0.1 * (1.0 if (s["type"] or "").lower() == (t["type"] or "").lower() else 0.5)) < 1e-12


def test_pagination_and_chunks(spark):
    paras = [f"Paragraph {i}. " + "word " * (20 + i * 7 % 50) for i in range(40)]
    docs = spark.createDataFrame([(1, "\n\n".join(paras)), (2, ""), (3, None)], "doc_id int, raw_text string")
    pages = structure.paginate(docs).where("doc_id = 1").orderBy("page").collect()
    assert [p.page for p in pages] == list(range(1, len(pages) + 1))
    assert "\n\n".join(p.text for p in pages).split() == " ".join(paras).split()
    chunks = structure.chunk_documents(docs, 800, 100).where("doc_id = 1").orderBy("chunk_index").collect()
    assert all(any(p.strip() in c.text for c in chunks) for p in paras)
    assert {c.total_chunks for c in chunks} == {len(chunks)}
    assert chunks[0].start_page == 1 and all(a.end_page == b.start_page for a, b in zip(chunks, chunks[1:]))


def test_overlap_tail():
    assert structure.overlap_tail("short", 10) == "short"
    assert structure.overlap_tail("x" * 50 + " one. Two three", 20) == "Two three"
    assert structure.overlap_tail("y" * 50, 20) == "y" * 20


DOC = "[Page 1]\nThe Tenant shall pay rent of $1,200.00 on the first day of each month.\n[Page 2]\nThe landlord may enter on 24 hours notice, except in emergencies."


@pytest.mark.parametrize(
    "quote, status, low",
    [
        ("The Tenant shall pay rent of $1,200.00", "verified", 1.0),
        ("the  tenant SHALL pay\nrent", "verified", 0.95),
        ("The landlord may enter on 24 hours notice except in emergencies", "verified", 0.85),
        ("Wholly invented words about quantum zebra farming licences", "unverified", 0.0),
        ("  ", "empty", 0.0),
        (None, "empty", 0.0),
    ],
)
def test_verify(spark, quote, status, low):
    docs = spark.createDataFrame([(1, DOC)], "doc_id int, raw_text string")
    quotes = spark.createDataFrame([(1, 1, "OBL-001", quote, None)], "doc_id int, ord int, obligation_id string, source_text string, source_location string")
    r = verify.verify(quotes, docs).first()
    assert r.status == status and r.confidence >= low
    assert r.is_verified == (status == "verified")
    if status == "unverified":
        assert r.is_hallucination == (r.confidence < 0.5) and r.issues[0].startswith("POSSIBLE")


def test_rate(spark):
    rows = [(1, s, 0.9) for s in ("verified", "verified", "partial", "unverified")] + [(2, "empty", 0.0)]
    out = verify.verification_report(verify.with_verdicts(spark.createDataFrame(rows, "doc_id int, status string, confidence double")))
    assert {r.doc_id: r.rate for r in out.collect()} == {1: 0.75, 2: 1.0}


def test_merge_and_tolerant_parse(spark):
    a = '```json\n{"parties":[{"name":"A","role":"x"}],"term":"","obligations":[{"id":"1","description":"d"}]}\n```'
    b = '{"parties":[{"name":"A","role":"y"},{"name":"B"}],"term":"2 years","auto_renewal":{"exists":true,"period":"1 year"},"obligations":[{"id":"1"}],"key_definitions":[{"term":"","definition":"z"},{"term":"T"}]}'
    rows = spark.createDataFrame([(1, 0, a), (1, 1, "not json"), (1, 2, b)], "doc_id int, chunk_index int, response string")
    p = extract.parse(rows)
    assert [(r.name, r.role) for r in extract.merge_parties(p).orderBy("ord").collect()] == [("A", "x"), ("B", "Unknown")]
    assert [r.id for r in extract.merge_obligations(p).orderBy("ord").collect()] == ["OBL-001", "OBL-002"]
    h = extract.merge_header(p).first()
    assert (h.term, h.auto_renewal.period, h.notes, h.chunks_processed) == ("2 years", "1 year", "JSON parsing error", 3)
    assert [r.term for r in extract.merge_definitions(p).collect()] == ["T"]
    with pytest.raises(ValueError):
        extract.RemoteExtractor(lambda p, t: "", None, "")


@pytest.mark.parametrize(
    "text, category, title",
    [
        ("Unlimited liability applies", "financial_exposure", "Unlimited liability exposure"),
        ("notice is given 45 days prior", "time_bomb", "Short notice period (<15 days)"),
        ("notice is given 20 days prior", "time_bomb", "Notice period (15-29 days)"),
        ("non-exclusive use", "competitive_restriction", "Exclusivity requirement"),
        ("respond promptly to all", "unclear_obligation", "Undefined timeline"),
        ("respond promptly 5 times", "unclear_obligation", None),
        ("substantially all assets", "unclear_obligation", "Undefined materiality"),
        ("substantial breach", "unclear_obligation", None),
        ("prior written consent", "consent_risk", "Prior approval required"),
        ("class action waiver", "dispute_resolution", "Class action waiver"),
    ],
)
def test_rules(spark, text, category, title):
    rows = spark.createDataFrame([(1, 1, "OBL-001", text, None, None, None)], "doc_id int, ord int, id string, description string, source_text string, source_location string, conditions string")
    got = {r.category: r.title for r in risk.score_risks(rows).collect()}
    assert got.get(category) == title


def test_greedy_is_in_order_not_optimal(spark):
    scores = [(1, 1, 1, 0.7), (1, 1, 2, 0.9), (1, 2, 2, 0.95), (1, 2, 1, 0.1), (1, 3, 1, 0.7)]
    out = evaluate.match_by_score(spark.createDataFrame(scores, "doc_id int, ord int, truth_ord int, score double"), 0.6)
    assert {r.ord: r.truth_ord for r in out.collect()} == {1: 2, 2: None, 3: 1}


def test_evaluation_report(spark, tmp_path):
    kind = "doc_id int, ord int, id string, source_text string, description string, party string, type string"
    mine = spark.createDataFrame([(1, i, f"OBL-00{i}", t, "d", "A", "payment") for i, t in enumerate(["pay the rent", *["#" * 5 + str(i) for i in range(6)]], 1)], kind)
    truth = spark.createDataFrame([(1, 1, "GT-1", "pay the rent", "d", "a", "payment"), (2, 1, "GT-1", "x", "d", "a", "payment")], kind)
    flags = "doc_id int, ord int, category string, severity string, title string, source_text string"
    risks = spark.createDataFrame([(1, 4, "time_bomb", "high", "T", "s"), (1, 9, "other", "low", "Q", None)], flags)
    true_risks = spark.createDataFrame([(1, 2, "time_bomb", "high", "T", "s")], flags)
    parties = spark.createDataFrame([(1, "A"), (1, "B")], "doc_id int, name string")
    header = spark.createDataFrame([(1, None, "2 years", ""), (2, None, None, None)], "doc_id int, effective_date string, term string, termination_notice_period string")
    report_rows = evaluate.evaluation_report((mine, truth), (risks, true_risks), (parties, parties.limit(1)), (header, header))
    evaluate.write_evaluation(report_rows, str(tmp_path / "out"))
    got = {r["doc_id"]: r for p in (tmp_path / "out").glob("part-*") for r in map(json.loads, p.read_text().splitlines())}
    assert got[1]["obligations"]["true_positives"] == 1 and got[1]["obligations"]["false_positives"] == 6
    assert [m["ground_truth_id"] for m in got[1]["risk_matches"]] == ["GT-RISK-1", None] and got[1]["risk_matches"][1]["system_id"] == "RISK-2"
    assert {k: v["match"] for k, v in got[1]["metadata_accuracy"].items()} == {"effective_date": True, "term": True, "termination_notice_period": False}
    assert len(got[1]["unmatched"]) == 6 and got[1]["unmatched"][-1] == "... and 1 more" and got[1]["unmatched"][0].startswith("OBL-002: No match found (best score: 0.")
    assert got[1]["overall_f1"] == pytest.approx((0.25 + 2 / 3) / 2) and got[2]["overall_f1"] == 0


def test_audit_folder(spark, tmp_path):
    for name in ("in", "notes"):
        (tmp_path / name).mkdir()
    (tmp_path / "in/a.txt").write_text("The seller shall deliver goods. The buyer must pay within ten days; nothing else.")
    items = [{"id": "OBL-001", "source_text": "the seller SHALL deliver goods."}, {"id": "OBL-002", "source_text": "Zebra farms are quite unlike this"}]
    (tmp_path / "notes/a_ground_truth.json").write_text(json.dumps({"obligations": items, "risk_flags": [{"title": "T", "source_text": "nothing else", "_audit_status": "done"}]}))
    found = audit_plan.audit_folder(spark, str(tmp_path / "in"), str(tmp_path / "notes"), str(tmp_path / "out"), prepare=True)
    assert found == {"VERIFIED": 2, "FLAGGED": 1}
    text = (tmp_path / "out/a_console.txt").read_text()
    assert "OK OBL-001: VERIFIED (100.0% match)" in text and "X OBL-002: FLAGGED" in text and "Summary: 1 verified, 0 likely ok, 1 flagged" in text and "[MUST]" in text
    ready = json.loads((tmp_path / "out/a_ground_truth.json").read_text())
    assert [o["_audit_status"] for o in ready["obligations"]] == ["pending"] * 2 and ready["risk_flags"][0]["_audit_status"] == "done"


def test_audit(spark):
    docs = spark.createDataFrame([(1, "The seller shall deliver. The buyer must pay; nothing else.\nshort\nHe agrees to all of it.")], "doc_id int, raw_text string")
    found = audit.keyword_sentences(docs)
    assert [(r.line_number, r.keyword) for r in found.orderBy("line_number", "ord").collect()] == [(1, "SHALL"), (1, "MUST"), (3, "AGREES")]
    items = spark.createDataFrame([(1, 1, "OBL-001", "obligation", "the seller SHALL deliver."), (1, 2, "OBL-002", "obligation", None)], "doc_id int, ord int, item_id string, item_type string, source_text string")
    assert {r.ord: r.status for r in audit.verify_quotes(items, docs).collect()} == {1: "VERIFIED", 2: "FLAGGED"}
    missed = audit.potential_misses(found, items)
    assert {r.keyword for r in missed.collect()} == {"MUST", "AGREES"}
    names = spark.createDataFrame([(1, "a.txt")], "doc_id int, name string")
    lines = audit.render_checklist(audit.verify_quotes(items, docs), missed, names).first().markdown.split("\n")
    assert lines[0] == "# Audit: a.txt" and "- [X] OBL-001: " in lines and "| Line 1 | The buyer must pay; | Review: contains 'must' |" in lines
    assert "| OBL-002 | Only 0% match - verify source text | Review |" in lines and "- 2 obligations verified: 1 exact, 0 likely, 1 flagged" in lines and "- 2 potential missed clauses found for review" in lines


def test_sources_and_whole_plan(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("TERMS\n\nThe client shall pay within ten days. Late fee of 15 % applies.\n\nThe firm must deliver.")
    (tmp_path / "in/b.TXT").write_bytes("caf\xe9 must close".encode("latin-1"))
    (tmp_path / "in/c.pdf").write_bytes(b"%PDF")
    docs = {r.stem: r for r in readers.read_documents(spark, str(tmp_path / "in")).collect()}
    assert docs["b"].raw_text == "café must close" and docs["c"].error and docs["a"].error is None
    good, bad = analysis.analyse_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert (good, bad) == (2, 1)
    assert "OBLIGATIONS (" in (tmp_path / "out/a_summary.txt").read_text()
    with pytest.raises(ValueError, match="Unsupported file type"):
        readers.require_supported("x.docx")


def test_stream_intake(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one")
    seen = []
    q = intake.run_batches(intake.stream_documents(spark, str(tmp_path / "in")), str(tmp_path / "ck"), lambda b: seen.extend(r.raw_text for r in b.collect()))
    q.awaitTermination(60)
    assert seen == ["one"]


def _value(x):
    return tuple(map(_value, x)) if isinstance(x, (list, tuple)) else x


def test_queries_equal_sql(spark):
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    sql = queries.oracle_sql()
    for name, query in queries.queries().items():
        df = query(spark, SF)
        rows = df.collect()
        assert rows, name
        if name in sql:
            cur = con.execute(sql[name])
            at = [[d[0] for d in cur.description].index(c) for c in df.columns]
            want = Counter(tuple(_value(r[i]) for i in at) for r in cur.fetchall())
            assert Counter(tuple(map(_value, r)) for r in rows) == want, name
