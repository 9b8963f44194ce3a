"""The console's summary scores risks once and verifies quotes once."""

from pyspark.sql import functions as F

from pactlens.operators import risk, verify
from pactlens.plans import queries


def _views(spark):
    clauses = [(d, k, f"OBL-00{k}", "Tenant", "payment", "Duty", None, text, "Section 2" if k % 2 == 0 else None, f"{k}. GENERAL") for d in (1, 2) for k, text in enumerate(("Customer shall pay a penalty of 12 % after that.", "The parties waive the right to a jury trial.", "Goods are delivered to the place named."), 1)]
    c = spark.createDataFrame(clauses, "doc_id long, ord int, id string, party string, type string, description string, conditions string, source_text string, source_location string, heading string")
    docs = c.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("source_text")), "\n").alias("raw_text"))
    quotes = c.select("doc_id", "ord", F.col("id").alias("obligation_id"), "source_location", F.when((F.col("doc_id") == 1) & (F.col("ord") == 3), "Nothing of the kind is here").otherwise(F.col("source_text")).alias("source_text"))
    renewals = spark.createDataFrame([(1, True, "1 month", None), (2, False, None, None)], "doc_id long, renews boolean, period string, notice string")
    return {"clauses": c, "docs": docs, "quotes": quotes, "renewals": renewals}


def test_each_step_is_worked_out_once(spark, monkeypatch):
    scored, verified = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(step, total):
        @F.udf("int")
        def seen(x):
            total.add(1)
            return x

        return lambda *a, **k: step(*a, **k).withColumn("ord", F.when(seen.asNondeterministic()("ord") > 0, F.col("ord")))

    plain = {r.doc_id: r.text for r in queries.console_summary(_views(spark)).collect()}
    monkeypatch.setattr(risk, "score_risks", counted(risk.score_risks, scored))
    monkeypatch.setattr(verify, "exact_verify", counted(verify.exact_verify, verified))
    found = {r.doc_id: r.text for r in queries.console_summary(_views(spark)).collect()}
    flags = risk.score_risks(_views(spark)["clauses"]).count()
    assert found == plain and "OBL-003: Source text could not be verified" in found[1] and "HIGH RISK" in found[1]
    assert flags > 0 and verified.value == 6
    assert scored.value <= 2 * flags  # the count above is one of them
