"""Whole plans over small folders: failures, named files, annotations, evaluation, rules."""

import json

import pytest
from pyspark.sql import functions as F

from pactlens.operators import evaluate, extract, report, risk
from pactlens.plans import analysis, evaluation
from pactlens.plans import audit as audit_plan
from pactlens.sources import named_files, readers


def folder(path, **files):
    path.mkdir(exist_ok=True)
    for name, content in files.items():
        to = path / name.replace("__", ".")
        to.write_bytes(content) if isinstance(content, bytes) else to.write_text(content, encoding="utf-8", newline="")
    return str(path)


def moody():
    """An extractor that raises on some documents: always, or the first times."""
    rules = extract.RuleExtractor()

    class Moody:
        calls = {}

        def __call__(self, text):
            if "IMPOSSIBLE" in text:
                raise RuntimeError("no answer to this")
            self.calls[text] = self.calls.get(text, 0) + 1
            if "SOMETIMES" in text and self.calls[text] < 3:
                raise TimeoutError("later")
            return rules(text)

    return Moody()


def test_a_document_that_fails_leaves_the_others(spark, tmp_path):
    inside = folder(tmp_path / "in", good__txt="The client shall pay within ten days.", bad__txt="IMPOSSIBLE. The client shall pay.", slow__txt="SOMETIMES the client shall pay.", empty__txt=" \n")
    counts = analysis.analyse_folder(spark, inside, str(tmp_path / "out"), moody(), stages=True)
    assert counts == (3, 1)
    names = {p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("_")}
    assert names == {f"{d}{e}" for d in ("good", "slow", "empty") for e in ("_analysis.json", "_summary.txt", "_report.md", "_extraction.json", "_risks.json", "_verification.json")}
    lines = [json.loads(x) for p in (tmp_path / "out/_errors").glob("part-*") for x in p.read_text().splitlines()]
    assert [(x["path"].rsplit("/", 1)[1], x["stage"], x["error"]) for x in lines] == [("bad.txt", "extract", "RuntimeError: no answer to this")]
    asked = spark.read.parquet(str(tmp_path / "out/_store/responses")).select(F.regexp_extract("doc_id", "([^/]+)$", 1).alias("d"), "attempts", "failure").collect()
    assert {(r.d, r.attempts, r.failure) for r in asked} == {("good.txt", 1, None), ("slow.txt", 3, None), ("bad.txt", 3, "RuntimeError: no answer to this")}
    good = json.loads((tmp_path / "out/good_analysis.json").read_text())
    assert good["file_name"] == "good.txt" and good["obligations"][0]["id"] == "OBL-001" and good["obligations"][0]["verified"] is True and good["obligations"][0]["deadline"] is None
    assert good["verification"] == {"rate": 1.0, "has_hallucinations": False, "items_needing_review": []} and good["auto_renewal"]["exists"] is False and good["parties"] == []
    empty = json.loads((tmp_path / "out/empty_analysis.json").read_text())
    assert empty["obligations"] == [] and empty["risk_summary"]["overall_risk_level"] == "low" and empty["risk_summary"]["high_risk_count"] == 0
    checked = json.loads((tmp_path / "out/good_verification.json").read_text())
    assert (checked["total_obligations"], checked["verified_count"], checked["results"][0]["status"]) == (1, 1, "verified")
    assert json.loads((tmp_path / "out/good_risks.json").read_text())["obligations_analyzed"] == 1
    kept = json.loads((tmp_path / "out/good_extraction.json").read_text())
    assert kept["chunks_processed"] == 1 and kept["obligations"][0]["source_text"] == "The client shall pay within ten days." and kept["key_definitions"] == []
    with pytest.raises(ValueError, match="attempt"):
        extract.extract(spark.createDataFrame([], "doc_id int, chunk_index int, total_chunks int, source_location string, text string"), attempts=0)


def test_kinds_of_files(spark, tmp_path):
    inside = folder(tmp_path / "in", a__Txt="one\r\ntwo\rthree", b__docx=b"\xff\xfe", c__TEXT=b"caf\xe9", d__pdf=b"%PDF two", e__PDF=b"%PDF bad")

    def pages(content):
        if b"bad" in content:
            raise ValueError("broken")
        return ["FIRST\n\npage", "", "third page"]

    got = {r.path.rsplit("/", 1)[1]: r for r in readers.read_documents(spark, inside, pages).collect()}
    assert got["a.Txt"].raw_text == "one\ntwo\nthree" and got["c.TEXT"].raw_text == "café"
    assert got["b.docx"].error == "Unsupported file type: .docx" and got["b.docx"].raw_text is None
    assert got["d.pdf"].pages == ["FIRST\n\npage", "", "third page"] and got["d.pdf"].raw_text.startswith("[Page 1]\nFIRST") and got["e.PDF"].error == "broken"
    assert {r.path.rsplit("/", 1)[1] for r in readers.read_documents(spark, inside, pages, unsupported=False).collect()} == {"a.Txt", "c.TEXT", "d.pdf", "e.PDF"}
    with pytest.raises(Exception, match="Unsupported file type"):
        readers.read_documents(spark, f"{inside}/b.docx", strict=True).select("raw_text").collect()
    assert readers.read_documents(spark, f"{inside}/a.Txt").count() == 1
    from pactlens.operators import structure

    chunks = structure.chunk_documents(analysis.documents(readers.read_documents(spark, inside, pages))).where("doc_id LIKE '%d.pdf'").collect()
    assert [(c.text, c.start_page, c.end_page, c.sections) for c in chunks] == [("FIRST\n\npage\n\nthird page", 1, 3, ["FIRST"])]


def test_named_files(spark, tmp_path):
    out = str(tmp_path / "files")
    rows = spark.range(50).select(F.concat(F.lit("n"), "id", F.lit(".txt")).alias("name"), F.concat(F.lit("text é "), "id").alias("content"))
    named_files.write_named(rows.repartition(4), out)
    assert {p.name: p.read_text() for p in (tmp_path / "files").glob("n*")} == {f"n{i}.txt": f"text é {i}" for i in range(50)}
    assert json.loads((tmp_path / "files/_manifest/_committed.json").read_text())["files"] == 50
    listed = [json.loads(x) for p in (tmp_path / "files/_manifest").glob("*.jsonl") for x in p.read_text().splitlines()]
    assert sorted(listed) == sorted(f"n{i}.txt" for i in range(50)) and not (tmp_path / "files/_attempts").exists()
    named_files.write_named(rows.where("id < 3").withColumn("content", F.lit("new")), out)
    assert (tmp_path / "files/n2.txt").read_text() == "new" and (tmp_path / "files/n3.txt").read_text() == "text é 3"
    for bad in ("../x", "", "_x", None):
        with pytest.raises(Exception, match="no name for a file"):
            named_files.write_named(spark.createDataFrame([("ok.txt", "a"), (bad, "b")], "name string, content string").coalesce(1), str(tmp_path / "broken"))
        left = [p for p in (tmp_path / "broken").rglob("*") if p.is_file()]
        assert not left
    stems = named_files.with_file_stem(spark.createDataFrame([("/a/x.txt",), ("/b/x.pdf",), ("/a/y",), ("/a/_z.txt",)], "doc_id string"))
    got = {r.doc_id: r.stem for r in stems.collect()}
    assert got["/a/x.txt"] == "x" and got["/b/x.pdf"].startswith("x-") and got["/a/y"] == "y" and got["/a/_z.txt"] == "-z"


def test_repeated_attempts_leave_nothing(tmp_path):
    """Two attempts write the same files, one of them counts; a third is lost half way."""
    w = named_files.NamedFilesWriter(str(tmp_path))
    first, second = w.write(iter([("a.txt", "x"), ("b.txt", None)])), w.write(iter([("a.txt", "x"), ("b.txt", None)]))

    def dies():
        yield "c.txt", "half"
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        w.write(dies())
    w.commit([second, None])
    files = {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()}
    assert files == {"_manifest/_committed.json", f"_manifest/{second.attempt}.jsonl", "a.txt", "b.txt"} and first.files == 2


def test_annotations_keep_what_they_have(spark, tmp_path):
    note = {"_contract_file": "x", "custom": {"deep": [1, 2.5, None, "é"]}, "_annotation_notes": "keep", "_audited": True, "_missed_obligations": [{"id": "M"}], "obligations": [{"id": "OBL-001", "source_text": "shall pay", "extra": 7, "_audit_notes": "mine"}], "risk_flags": [{"title": "T", "severity": "high", "source_text": "zzz qqq"}]}
    folder(tmp_path / "in", a__txt="The client shall pay. The firm must deliver goods soon.")
    folder(tmp_path / "notes", a_ground_truth__json=json.dumps(note), b_ground_truth__json="{}")
    audit_plan.audit_folder(spark, str(tmp_path / "in"), str(tmp_path / "notes"), str(tmp_path / "out"), prepare=True)
    want = json.loads(json.dumps(note)) | {"_audit_date": None, "_audit_notes": "", "_false_positives": []}
    want["obligations"][0]["_audit_status"] = "pending"
    want["risk_flags"][0] |= {"_audit_status": "pending", "_audit_notes": ""}
    assert json.loads((tmp_path / "out/a_ground_truth.json").read_text()) == want
    assert json.loads((tmp_path / "out/b_ground_truth.json").read_text()) == {"_audited": False, "_audit_date": None, "_audit_notes": "", "_missed_obligations": [], "_false_positives": []}
    again = readers.read_annotations(spark, str(tmp_path / "out")).where("stem = 'a'")
    assert again.select(readers.prepared_json("raw").alias("j")).first().j == (tmp_path / "out/a_ground_truth.json").read_text()
    lines = (tmp_path / "out/a_audit.md").read_text().split("\n")
    assert "- [X] OBL-001: " in lines and "- [FLAG] RISK-001: T (HIGH)" in lines and any(x.startswith("| Line 1 | The firm must deliver goods soon. |") for x in lines)
    assert not (tmp_path / "out/b_audit.md").exists()
    folder(tmp_path / "broken", a_ground_truth__json="{nope")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        readers.read_annotations(spark, str(tmp_path / "broken")).collect()


def test_evaluation_of_a_folder(spark, tmp_path):
    inside = folder(tmp_path / "in", a__txt="The client shall pay within ten days. The firm must deliver goods.", b__txt="IMPOSSIBLE", c__txt="No notes on this.")
    note = {"parties": [{"name": "X"}], "term": None, "auto_renewal": {"exists": False}, "obligations": [{"id": "G1", "party": "Unknown", "type": "requirement", "description": "The client shall pay within ten days.", "source_text": "The client shall pay within ten days."}, {"id": "G2", "source_text": "zebra"}]}
    notes = folder(tmp_path / "notes", a_ground_truth__json=json.dumps(note), b_ground_truth__json=json.dumps(note))
    found = evaluation.evaluate_folder(spark, inside, notes, str(tmp_path / "out"), moody())
    assert found["n"] == 1 and found["obligation_f1"] == pytest.approx(0.5) and found["overall_f1"] == pytest.approx(0.25)
    got = json.loads((tmp_path / "out/a_evaluation.json").read_text())
    assert got["obligations"] == {"precision": 0.5, "recall": 0.5, "f1_score": 0.5, "true_positives": 1, "false_positives": 1, "false_negatives": 1}
    assert [m["ground_truth_id"] for m in got["obligation_matches"]] == ["G1", None] and got["parties"]["recall"] == 0.0
    assert got["metadata_accuracy"]["auto_renewal_exists"]["match"] is True and got["metadata_accuracy"]["term"] == {"match": True, "system": None, "ground_truth": None}
    text = (tmp_path / "out/a_evaluation.txt").read_text()
    assert "  Precision: 50.0% (1/2)" in text and "UNMATCHED SYSTEM OBLIGATIONS" in text and "OVERALL F1 SCORE: 25.0%" in text
    errors = {x["stem"]: x["error"] for p in (tmp_path / "out/_errors").glob("part-*") for x in map(json.loads, p.read_text().splitlines())}
    assert errors == {"b": "RuntimeError: no answer to this", "c": "no annotations"}


def test_greedy_equals_a_plain_loop(spark):
    import random

    rng = random.Random(3)
    word = lambda: rng.choice(["pay rent", "pay the rent now", "give notice", "notice of rent", "", "x" * 220, "deliver"])
    kind = "doc_id int, ord int, party string, type string, description string, source_text string"
    rows = lambda n: [(rng.randrange(12), k, rng.choice(["A", "a", "B", None]), rng.choice(["payment", "other"]), word(), word()) for k in range(n)]
    system, truth = rows(90), rows(70)
    got = {(r.doc_id, r.ord): (r.truth_ord, r.score, r.match_type) for r in evaluate.match_greedy(spark.createDataFrame(system, kind), spark.createDataFrame(truth, kind)).collect()}
    names = ["doc_id", "ord", "party", "type", "description", "source_text"]
    want = {}
    for doc in {r[0] for r in system}:
        left = [dict(zip(names, r)) for r in sorted(truth) if r[0] == doc]
        for s in (dict(zip(names, r)) for r in sorted(system) if r[0] == doc):
            best, at = 0.0, None
            for t in left:
                if (x := evaluate.obligation_score(s, t)) > best:
                    best, at = x, t
            if at and best >= 0.6:
                left.remove(at)
            want[doc, s["ord"]] = (at["ord"], best, "exact" if best >= 0.85 else "partial") if at and best >= 0.6 else (None, best, "none")
    assert got == want


def test_rules_from_a_table(spark):
    kind = "doc_id int, ord int, id string, description string, source_text string, source_location string, conditions string"
    rows = spark.createDataFrame([(1, 1, "OBL-001", "Unlimited liability applies; a moon clause", "notice is given 20 days prior", None, None), (1, 2, "OBL-002", "Prior written consent", None, None, None)], kind)
    table = risk.rules_table(spark)
    assert table.count() == sum(len(r[4]) for r in risk.RULES.values())
    key = lambda df: sorted(map(str, df.collect()))
    assert key(risk.score_risks(rows, rules=table)) == key(risk.score_risks(rows)) and key(risk.rule_matches(rows, table)) == key(risk.rule_matches(rows))
    own = spark.createDataFrame([("lunar", 99, 0, r"\bmoon\b", "Moon clause", "high", "Look up", "Ask", "It shines: ")], risk.RULE_TABLE)
    more = risk.score_risks(rows, rules=table.unionByName(own))
    assert [(r.category, r.title, r.severity, r.description[:33]) for r in more.where("category = 'lunar'").collect()] == [("lunar", "Moon clause", "high", "Moon clause detected. It shines: ")]
    assert more.count() == risk.score_risks(rows).count() + 1
    for change, says in (({"pattern": "("}, "regular"), ({"severity": "odd"}, "severity"), ({"title": None}, "without")):
        with pytest.raises(ValueError, match=says):
            risk.load_rules(own.withColumns({k: F.lit(v).cast("string") for k, v in change.items()}))
    with pytest.raises(ValueError, match="differ"):
        risk.load_rules(own.unionByName(own.withColumn("severity", F.lit("low"))))


def test_report_layouts(spark):
    flags = [(1, k, 0, "OBL-001", "time_bomb", s, f"Flag {k}", "d" * 100, "q", "Section 1", "act", "talk") for k, s in enumerate(["high", "medium", "low"], 1)]
    flag_kind = "doc_id int, ord int, set_ord int, obligation_id string, category string, severity string, title string, description string, source_text string, source_location string, action_required string, negotiation_suggestion string"
    flags = spark.createDataFrame(flags, flag_kind)
    obligations = spark.createDataFrame([(1, k, f"OBL-{k:03d}", "A", "payment", "words " * 20, "Friday" if k == 1 else None, None, "q", "S") for k in range(1, 13)], "doc_id int, ord int, id string, party string, type string, description string, deadline string, conditions string, source_text string, source_location string")
    results = spark.createDataFrame([(1, 1, "OBL-001", "unverified", 0.1, "q", None, None, ["issue"], False, True)], "doc_id int, ord int, obligation_id string, status string, confidence double, source_text string, matched_text string, match_location string, issues array<string>, is_verified boolean, is_hallucination boolean")
    header = spark.createDataFrame([(1, "", "2 years", None, (True, "1 year", None), "", 1)], "doc_id int, effective_date string, term string, termination_notice_period string, auto_renewal struct<`exists`:boolean,period:string,notice_to_cancel:string>, notes string, chunks_processed long")
    parties = spark.createDataFrame([(1, 1, "Ann", "buyer", True), (1, 2, "Bob", "seller", False)], "doc_id int, ord int, name string, role string, is_reader boolean")
    definitions = spark.createDataFrame([(1, 1, "Fee", "money", "S2")], "doc_id int, ord int, term string, definition string, source_location string")
    from pactlens.operators import verify

    summary, checked = risk.risk_summary(flags), verify.verification_report(results)
    rows = report.build_report(header, parties, definitions, obligations, flags, results, checked, summary, report.summary_text(header, parties, obligations, checked, summary), F.lit("2024-05-06 07:08:09").cast("timestamp"))
    text = report.render_text(rows).first().text.split("\n")
    for line in ("Document: 1", "Generated: 2024-05-06T07:08:09", "  - Ann (buyer) [YOU]", "  - Bob (seller)", "  Effective Date: Not specified", "  Term: 2 years", "      Period: 1 year", "      Notice to Cancel: None", "RISK ASSESSMENT: MEDIUM", "  1. Flag 1", "     " + "d" * 80 + "...", "     Action: act", "  1. Flag 2 (Section 1)", "[LOW RISK] Minor Items: 1 found", "  [?] OBL-001: Source text could not be verified", "  [!] OBL-001: High-risk clause: Flag 1", "  Verification Rate: 0.0%", "  [WARNING] Possible hallucinations detected - review flagged items", "OBLIGATIONS (12 total)", "  [OBL-001] A [HIGH RISK]", "    Deadline: Friday", "  ... and 2 more obligations", "END OF REPORT"):
        assert line in text, line
    marked = report.render_markdown(rows, "made here").first().markdown.split("\n")
    for line in ("| Parties | Ann (buyer), Bob (seller) |", "| Overall Risk | **MEDIUM** |", "> Notice to Cancel: None", "#### Flag 1", "- **Negotiation Tip:** talk", "| Flag 2 | time_bomb | Section 1 |", "### Low Risk (1 items)", "- **OBL-001**: Source text could not be verified", "| OBL-001 | A | payment | " + ("words " * 20)[:50] + "... | **HIGH** |", "*made here*"):
        assert line in marked, line
    data = json.loads(report.report_json(rows).first().json)
    assert data["key_definitions"] == [{"term": "Fee", "definition": "money", "source_location": "S2"}] and data["risk_summary"] == {"high_risk_count": 1, "medium_risk_count": 1, "low_risk_count": 1, "most_concerning": "Flag 1 (time_bomb)", "overall_risk_level": "medium"}
    assert data["verification"]["items_needing_review"][0]["details"] == ["issue"] and len(data["obligations"]) == 12 and data["obligations"][0]["risk_flags"] == ["Flag 1", "Flag 2", "Flag 3"]


def test_entry_points(spark, tmp_path):
    from pactlens import api

    inside = folder(tmp_path / "in", a__txt="1. FEES AND TERMS\n\nThe client shall pay within ten days and accepts unlimited liability.", b__docx="x")
    one = f"{inside}/a.txt"
    for path in (inside, one):
        assert [r.raw_text[:7] for r in api.read(spark, path).collect()] == ["1. FEES"]
    assert api.chunks(spark, one).first().sections == ["1. FEES AND TERMS"]
    results, checked = api.verification(spark, one)
    assert (results.first().status, checked.first().rate) == ("verified", 1.0)
    flags, summary = api.risks(spark, one)
    assert "Unlimited liability exposure" in {r.title for r in flags.collect()} and summary.first().overall in ("medium", "high")
    assert json.loads(api.reports(spark, one).first().json)["file_name"] == "a.txt" and json.loads(api.extraction(spark, one).first().json)["chunks_processed"] == 1


def test_stream_of_reports(spark, tmp_path):
    from pactlens.streaming import intake

    inside = folder(tmp_path / "in", a__txt="The client shall pay within ten days.", bad__TXT="IMPOSSIBLE")
    go = lambda: intake.stream_analysis(spark, inside, str(tmp_path / "out"), str(tmp_path / "check"), moody(), attempts=1).awaitTermination(120)
    go()
    assert {p.name for p in (tmp_path / "out").glob("*.json")} == {"a_analysis.json"}
    folder(tmp_path / "in", c__txt="The firm must deliver.")
    go()
    assert {p.name for p in (tmp_path / "out").glob("*.json")} == {"a_analysis.json", "c_analysis.json"}
    errors = [json.loads(x)["error"] for p in (tmp_path / "out/_errors").glob("*/part-*") for x in p.read_text().splitlines()]
    assert errors == ["RuntimeError: no answer to this"]
