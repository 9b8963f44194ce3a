"""From raw documents to token ids: five stages, each written and read again.

language ID (texts in no known language go), n-gram Jaccard join (one document of each
group of near copies stays: five words, similarity 0.8), substring dedup (passages of 35
words or more that recur go from the texts), benchmark decontamination (documents with a
benchmark item go), byte-level BPE (ids of every text, and the digests of a round trip).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlens.llm import byte_bpe, decontaminate, jaccard_join, langid, substring_dedup
from pactlens.llm.common import drop_work_table, fresh, work_table

#: Less than this is no better than guessing among a few languages.
LEAST_SCORE = 0.3

#: SQL cannot express the language model; the stages are tested one by one.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is known; nulls and texts without letters go."""
    model = langid.fit(docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 != 2, F.lit(True))))
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = langid.identify(docs, model, lang_as=lang, score_as=score)
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near copies."""
    return jaccard_join.one_of_each(docs, n=5, num=80, den=100)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut recurring passages; a text that loses none stays as it is, of another the
    words that stay are joined by one blank. n_chars follows."""
    others = [c for c in docs.columns if c != "doc_id"]
    out = substring_dedup.dedup_substrings(docs, window=35, carry=tuple(others))
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("rest.text"))
    cols = {c: F.col(f"rest.`{c}`") for c in others} | {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.char_length(F.col("kept").cast("string")).cast("long")).otherwise(F.col("rest.n_chars"))}
    return out.select(*[F.col("doc_id") if c == "doc_id" else cols[c].alias(c) for c in docs.columns])


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip_digests(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", decontaminate_benchmark),
    ("byte_level_bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        docs = work_table(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            drop_work_table(last)
        last = docs
    return docs
