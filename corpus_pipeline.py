"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame."""

from functools import reduce

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm.bpe import bpe_encode
from hopweave.llm.common import staged
from hopweave.llm.exact_dedup import exact_dedup
from hopweave.llm.language_id import language_id
from hopweave.llm.mixing import mix
from hopweave.llm.near_dedup import near_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Characters of file names that may be broadcast.
PATHS = 64 << 20
#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with _row, a key of each row's own whatever its id, and _hash, which orders rows alike in every run.

    The key of a row of a file is the file's number and the row's place in it, the same however the file is split. Rows that come from elsewhere are written first.
    """
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_hash"))
    try:
        placed = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_hash"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))
        paths = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())  # as many as files
    except AnalysisException:
        return staged(rows.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    files = docs.sparkSession.createDataFrame(list(enumerate(paths)), "_file long, _path string")
    if sum(map(len, paths)) < PATHS:  # else Spark joins it as it sees fit
        files = F.broadcast(files)
    return placed.join(files, "_path").withColumn("_row", F.shiftleft("_file", 40).bitwiseOR(F.col("_at"))).drop("_path", "_at", "_file")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; the language that was found replaces the given one."""
    found = language_id(docs, carry=("text", "source", "n_chars")).where(F.col("lang_pred") != "und")
    return found.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, one of the largest doc_id."""
    rows = _keyed(docs)
    kept = exact_dedup(rows, carry=("_hash", "_row")).where("kept").groupBy("text_sha256").agg(F.min(F.struct("_hash", "_row")).alias("least"))
    return rows.join(kept.select("least._row"), "_row", "left_semi").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, the one of the smallest doc_id. Each row is a document; one without an id is linked with nothing and stays."""
    rows = _keyed(docs)
    named = rows.where(F.col("doc_id").isNotNull())
    parts = near_dedup(named.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    least = parts.join(named.select("_row", "doc_id", "_hash"), "_row").groupBy("component_id").agg(F.min(F.struct("doc_id", "_hash", "_row")).alias("least"))
    kept = least.select("least._row").union(rows.where(F.col("doc_id").isNull()).select("_row"))
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each take of a document; a document that the mix takes nothing of goes. The one document a source that the target cuts comes whole."""
    rows = _keyed(docs)
    takes = mix(rows, carry=("_row",)).select("_row", (F.col("position").isNotNull().cast("int") + F.col("again").isNotNull().cast("int")).alias("_takes")).where(F.col("_takes") > 0)
    return rows.join(takes, "_row").select(*COLUMNS, F.explode(F.sequence(F.lit(1), "_takes"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, a row for each take."""
    return bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False).drop("ids", "decoded")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixture", mixture), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return reduce(lambda df, stage: stage[1](spark, staged(df, "pipeline"), sf_dir), STAGES[1:], STAGES[0][1](spark, docs, sf_dir))
