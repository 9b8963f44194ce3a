"""Steps that are made once for a text: literals before patterns, normal forms, headings."""

import random
import re

import pytest

from pactlens.functions.needed import needed
from pactlens.functions.text import _runs, norm_text, ratio, ratio_bound, ratio_from
from pactlens.operators import audit, risk, structure, verify

CLAUSES = "doc_id long, ord int, id string, description string, source_text string, conditions string, source_location string"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("pattern", ["(?i)ABC", r"\Qa\E", "[a&&b]x", "a*", "(a|b*)", r"\x41", "("])
def test_no_literal_is_known(pattern):
    assert needed(pattern) is None


def test_a_match_holds_a_literal():
    rng = random.Random(4)
    words = sorted({w for _, _, _, _, rules in risk.RULES.values() for p, _ in rules for w in re.findall("[a-z]+", p)}) + ["5", "18", "%", "12 days", "-"]
    rules = [p for *_, rules in risk.RULES.values() for p, _ in rules]
    hits = 0
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(14))
        for p in rules:
            if re.search(p, text):
                hits += 1
                assert any(x in text for x in needed(p)), (p, text)
    assert hits > 1000


def test_rules_are_tried_once(spark):
    rows = spark.createDataFrame([(1, 1, "OBL-001", "d", "Unlimited  liability; best efforts", None, None), (1, 2, "OBL-002", None, None, None, None)], CLAUSES)
    found = risk.rule_matches(rows)
    assert {(r.ord, r.category, r.rule) for r in found.collect()} == {(1, "financial_exposure", 0), (1, "unclear_obligation", 1)}
    assert _plan(found).count("liquidated\\s+damages") == 1
    assert _plan(risk.score_risks(rows).select("title")).count("liquidated\\s+damages") == 1


def test_letters_that_stand_for_ascii_ones(spark):
    text = "The tenant ſhall pay.\nThe tenant agrees, wıll  not sue.\nNobody marshalls it here. Short."
    found = audit.keyword_sentences(spark.createDataFrame([(1, text)], "doc_id long, raw_text string"))
    assert [(r.line_number, r.keyword) for r in found.orderBy("line_number", "ord").collect()] == [(1, "SHALL"), (2, "AGREES")]
    assert _plan(found).count("prohibited\\b") == 1


def test_headings_need_no_second_shuffle(spark):
    text = "1. GENERAL\nThe first.\n\n2. TERM\n\nThe 2. TERM ends.\n\n \n"
    pages = spark.createDataFrame([(1, 1, text), (2, 1, ""), (3, 1, "plain")], "doc_id long, page int, text string")
    a = structure.paragraph_sections(structure.paragraphs(pages), structure.sections(pages))
    b = structure.page_paragraphs(pages).where("text IS NOT NULL")
    key = lambda r: (r.doc_id, r.ord, r.text, list(r.sections))
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))
    assert len(a.collect()) == 4
    assert not re.search(r"Aggregate \[[^\]]*text", _plan(a))


def test_normal_forms_are_made_before_the_join(spark):
    docs = spark.createDataFrame([(1, "One “thing” – done.  Two `THINGS` stand here. Three.")], "doc_id long, raw_text string")
    quotes = spark.createDataFrame([(1, 1, "a", 'two "things" stand', None), (1, 2, "b", "one “thing” - done", None)], "doc_id long, ord int, obligation_id string, source_text string, source_location string")
    rows = verify.exact_verify(quotes, docs)
    assert {r.ord: (r.confidence, r.matched_text) for r in rows.collect()} == {1: (0.95, "Two `THINGS` stand here"), 2: (0.95, "One “thing” – done")}
    assert ".norm, regexp_replace" not in _plan(rows)
    assert docs.select(norm_text("raw_text")).first()[0] == 'one “thing” - done. two "things" stand here. three.'


def test_run_tables_and_bounds():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc é") for _ in range(rng.randrange(1, 40))) for _ in range(2))
        runs = _runs(a, b)
        for i in range(len(a)):
            for j in range(len(b)):
                assert runs[i, j] == (0 if a[i] != b[j] else 1 + (runs[i - 1, j - 1] if i and j else 0))
        assert ratio_bound(a, b) >= ratio(a, b)
        assert ratio_from(a, b, 0.0) == ratio(a, b)


def test_misses_take_few_ratios(spark, monkeypatch):
    quotes = ["the tenant shall pay the rent on time", "goods are inspected on arrival by the buyer", "zzzz qqqq xxxx", "supplier may raise prices"]
    taken = []
    monkeypatch.setattr(audit, "ratio_from", lambda a, b, least: taken.append(b) or ratio_from(a, b, least))
    sentence = "The tenant shall pay the rent in time"
    got = audit._open_quotes(quotes)({"sentence": sentence})[0]
    assert got == max(ratio(sentence.lower(), q) for q in quotes)
    assert len(taken) == 1
