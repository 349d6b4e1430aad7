"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last
return the columns of ``documents``. Stages are written as Parquet and read again in between.

Rows that repeat a doc_id with another text are documents of their own in every stage; none is
dropped, cut or repeated because of another. Null texts pass all filters, rows without doc_id keep
their lines, repeated rows stay repeated, other columns of the input are left out, and no rows give
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm.common import listed, stored, table
from pairlens.llm.line_edits import drop_duplicate_lines
from pairlens.llm.mixing import mix
from pairlens.llm.order_minhash import keep_one
from pairlens.llm.packing import pack
from pairlens.llm.toxicity import fit, score_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not mark as toxic, unchanged."""
    scored = score_documents(docs.select(*COLUMNS), fit(docs, table(spark, sf_dir, "labels")))
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line is within two edits of; emptied documents go."""
    return drop_duplicate_lines(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of every near-duplicate class."""
    return keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: rows not taken go, others may be repeated."""
    docs = docs.select(*COLUMNS)
    # Rows of one doc_id and source are taken alike, whatever their texts.
    key = [F.col("doc_id").alias("_id"), F.col("source").alias("_source")]
    taken = mix(docs).where("repeats > 0").select(*key, "repeats").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
    rows = docs.join(listed(stored(taken)), same)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "repeats"))
    return rows.withColumn("_copy", copies).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express the classifier, so the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
