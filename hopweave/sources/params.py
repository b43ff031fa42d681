"""Query parameters from text files, and results to files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_params(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each line after the header of a space-separated file, numbered in query_id. The last column takes the rest of the line, spaces too.

    Lines that are too short, or whose numbers can't be read, have nulls. Line numbers come from the one file's order, which such files of a few rows keep.
    """
    return parse_params(spark.read.text(path).select("value", F.monotonically_increasing_id().alias("query_id")), schema)


def parse_params(lines: DataFrame, schema: str) -> DataFrame:
    """The same from lines (value, query_id), of which the header has number 0."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    parts = F.split(F.trim("value"), " ", len(fields))
    return lines.where("query_id > 0").select("query_id", *(F.get(parts, F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields))).where(F.col(fields[0][0]).isNotNull())


def write_results(result: DataFrame, path: str) -> None:
    """The rows as JSON lines in a new folder."""
    result.write.json(path)
