from pactlens.operators import evaluate


def test_a_pair_ruled_out_by_its_subsequence_takes_no_ratio(monkeypatch):
    monkeypatch.setattr(evaluate, "ratio_from", lambda *a: 1 / 0)
    assert evaluate._similar("abcdefghij", "jihgfedcba", 0.5) == -1.0
