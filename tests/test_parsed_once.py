"""Answers are parsed once for a list of theirs."""

import io
from contextlib import redirect_stdout

from pactlens.operators import extract


def test_answers_are_parsed_once_for_a_list(spark):
    fenced = ["{}", 'x ```json {"obligations":[{"party":"a"},{}]} ``` y', '```{"obligations":[]}```', "``````", "no JSON", None, '{"obligations":null}', '{"obligations":[{"party":"b"}],"key_definitions":[{"term":"t"}],"parties":[{"name":"n"}]}']
    responses = spark.createDataFrame([(1, k, x) for k, x in enumerate(fenced)], "doc_id int, chunk_index int, response string")
    parsed = extract.parse(responses)
    merged = [extract.merge_obligations(parsed), extract.merge_definitions(parsed), extract.merge_parties(parsed)]
    for rows in merged:
        out = io.StringIO()
        with redirect_stdout(out):
            rows.explain()
        assert out.getvalue().count("from_json(") == 1
    assert [(r.id, r.party) for r in merged[0].orderBy("ord").collect()] == [("OBL-001", "a"), ("OBL-002", "Unknown"), ("OBL-003", "b")]
    assert [r.term for r in merged[1].collect()] == ["t"] and [r.name for r in merged[2].collect()] == ["n"]
