"""The corpus pipeline: documents in, token digests of the mixed and cleaned corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's result below the shared
folder and reads it back as the next one's ``docs``. All stages but the last keep the columns of ``documents``.

Defined results: a null or letterless text is rejected by the first stage; of rows with one doc_id one stays after
the second; rows without doc_id pass the second stage, as no class can name them; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.llm import bpe, langid, mixing, ngram_join, secrets
from jobloom.llm.common import read_table, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in which no language can be told (null, or without a letter); fills a missing language.

    The cosine itself rejects nothing: it is low for short clean texts too. Where no document has both text and a
    language nothing can be learnt, so nothing is judged and all documents stay.
    """
    model = langid.fit(docs)
    if not model[0]:
        return docs
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")  # texts are sent once
    kept = langid.predict(rows, model, keep=("row", "text")).filter(F.col("lang_pred") != langid.UNDETERMINED)
    column = lambda c: F.coalesce("row.lang", "lang_pred") if c == "lang" else F.col("row").getField(c)
    return kept.select(*["text" if c == "text" else column(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each class of near duplicates."""
    classes = ngram_join.join(docs)
    first = classes.filter("doc_id = component_id").select("doc_id").distinct()
    once = Window.partitionBy("row.doc_id").orderBy("row.text", "row.source", "row.lang")
    named = docs.join(first, "doc_id").select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    named = named.withColumn("nth", F.row_number().over(once)).filter("nth = 1")
    return named.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).union(docs.filter("doc_id IS NULL"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every reported secret; all documents stay."""
    return secrets.masked(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")
    taken = mixing.mix(rows).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth"))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and the digest of the bytes they decode to."""
    return bpe.digest(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mix", mix), ("tokens", tokens)]

#: SQL cannot express the stages; ``tests/llm`` holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
