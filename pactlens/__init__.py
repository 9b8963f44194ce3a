"""Agreement analytics on Spark DataFrames: structure, extraction, verification, risk, evaluation, audit, reports."""
