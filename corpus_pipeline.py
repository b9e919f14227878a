"""The corpus pipeline: language ID, toxicity, near-dedup, substring dedup, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on every row of ``docs``; all but the last return the columns of
``docs``. Empty tables pass through as empty tables, null texts are what each operator's docstring says.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm.common import materialise
from kbspark.llm.language_id import predict_language, train_language_model
from kbspark.llm.minhash_dedup import near_duplicate_documents
from kbspark.llm.packing import pack_documents
from kbspark.llm.substring_dedup import remove_repeats
from kbspark.llm.toxicity import score_toxicity

#: SQL cannot express the models of the first two stages; the stages are tested against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told: rejected are those without letters and those under a score of 0.5."""
    trained = train_language_model(docs)
    told = predict_language(docs, trained, keep=docs.columns, names=("_kb_lang", "_kb_score"))
    return told.filter("_kb_lang <> 'und' and _kb_score >= 0.5").select(docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are not predicted toxic. Rows are judged one by one, null and repeated ids included."""
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = scored.filter("predicted = 1").select(F.col("doc_id").alias("_kb_id"), F.col("text_hash").alias("_kb_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_kb_id")) & (F.xxhash64("text") == F.col("_kb_hash"))
    return docs.join(rejected, same, "left_anti").select(docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_kb_row``, which tells its rows apart however often they are read.

    Rows of Parquet files are known by file and place in it, so nothing is written; others are written once with a number.
    """
    try:
        return docs.select("*", F.concat_ws(":", "_metadata.file_path", F.col("_metadata.row_index")).alias("_kb_row"))
    except AnalysisException:
        return materialise(docs.withColumn("_kb_row", F.monotonically_increasing_id()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates, that with the smallest id: five-word shingles, a similarity of 0.8 or more.

    Rows are judged by their texts, whatever their ids: of rows that repeat an id those with other texts are judged by
    themselves, of equal rows one stays, and a row with a null id stays only if no row of its group has an id. Rows without
    words stay.
    """
    rows = _numbered(docs)
    found = near_duplicate_documents(rows, id_col="_kb_row", width=5, percent=80).select("_kb_row", "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_kb_row")
    first = found.join(rows.select("_kb_row", "doc_id"), "_kb_row").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select(F.col("first._kb_row").alias("_kb_row")), "_kb_row", "left_semi").select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each text that repeats passages of smaller documents by the words that it keeps; other texts stay as they are."""
    others = [c for c in docs.columns if c != "doc_id"]
    found = remove_repeats(docs, keep=others, keep_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their ids."""
    return pack_documents(docs, keep_ids=True)


STAGES = [("language ID", language), ("toxicity", toxic), ("MinHash near-dedup", near_duplicates), ("substring dedup", repeats), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
