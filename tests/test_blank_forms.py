"""White space is trimmed and normalised as by patterns."""

from pactlens.functions import text as T
from pyspark.sql import functions as F

ODD = [chr(c) for c in (*range(0, 33), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF, 0x1F600)]


def test_forms_are_those_of_the_patterns(spark):
    texts = [None, "", " ", "\n \t", "a", "`– —`"] + [x for c in ODD for x in (c, c + "A" + c, c + " A" + c + c + "b \n", "A" + c + "b", "\n" + c)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, x string")
    old_strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    old_norm = old_strip(F.translate(F.regexp_replace(F.lower("x"), r"(?U)\s+", " "), "`–—", '"--'))
    old_audit = F.lower(old_strip(F.regexp_replace("x", r"(?U)\s+", " ")))
    x = F.col("x")
    pairs = [(T.strip(x), old_strip(x)), (T.norm_text(x), old_norm), (T.audit_norm(x), old_audit), (T.is_blank(x), old_strip(F.coalesce(x, F.lit(""))) == "")]
    for new, old in pairs:
        assert rows.where(~new.eqNullSafe(old)).collect() == []
