"""Cleaning of a document table in stages: toxicity, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns a DataFrame; all but the last
return the columns of ``documents``. ``n_chars`` follows the text where a stage changes it. Rows with a null in any column
are kept unless a decision is against their text; further columns pass all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxgraph import session
from ctxgraph.llm import bpe, decontam, neardup, pii, toxicity


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The model learns from the labels of the rows at hand. Null and empty texts score
    below 0.5 and stay."""
    session.ship(spark)
    net = toxicity.fit(docs, session.table(spark, sf_dir, "labels"))
    out = _unused(docs, "toxicity")
    return toxicity.score(docs, net, out=out).where(F.col(out) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the smallest id stays; of rows that share its id, one. Rows
    without an id or a text are in no class and stay."""
    session.ship(spark)
    return neardup.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Null and empty texts contain none."""
    session.ship(spark)
    out = _unused(docs, "leaks")
    return decontam.find(docs, session.table(spark, sf_dir, "benchmark"), out=out).where(F.size(out) == 0).select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets pseudonyms of the same form; no document goes, null texts stay null."""
    session.ship(spark)
    spans = _unused(docs, "pii_spans")
    out = pii.pseudonymise(docs, pii.key_of(spark), spans=spans)
    return out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, packed as little-endian unsigned 32-bit integers, with their number, in place of the text; decoded
    again to show the round trip. A null text has none; further columns are left out."""
    session.ship(spark)
    return bpe.encode(docs, decoded="decoded").select(
        "doc_id", "lang", "source", "n_chars",
        F.expr("CAST(octet_length(token_ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        "token_ids",
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", hide_personal_data),
    ("tokens", tokenise),
]

#: SQL can't express the recurrent network, the graph search or the merges; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again. What a stage wrote on its
    way goes when its result is there, and so does the result before."""
    docs, since = session.table(spark, sf_dir, "documents"), session.cuts_so_far(spark)
    for name, stage in STAGES[:-1]:
        docs = session.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        session.drop_cuts(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
