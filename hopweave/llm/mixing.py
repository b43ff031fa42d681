"""Mixing sources to target weights by a time-varying curriculum.

Each source has a schedule of its weight over training time, 1 + tilt - 2 * tilt * t times its share. The integral of the schedule is the
source's cumulative token demand; a document that begins at a given token of its source is placed at the time when the demand reaches
that token, which is the inverse of the integral. Documents are then range-sorted by position. DataFrame operations only.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, running_total, staged

#: Weights and tilts of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
TILTS = (0.5, 0.0, -0.5)
SHARE = 1.5
CAP = 2.0


def _turns(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def targets(sized: DataFrame) -> DataFrame:
    """A row a source: source_size, target and tilt. Targets share SHARE of all sizes by weight; what is above CAP times a source's size is shared anew.

    In order of cap over weight, the sources that reach their cap come first; the level is what is left after their caps over the weights of
    the others. The windows run over the table of sources, a row each.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    one = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = one.withColumn("_at", F.row_number().over(order) - 1).withColumn("_weight", _turns(WEIGHTS, F.col("_at")).cast("double")).withColumn("tilt", _turns(TILTS, F.col("_at")))
    one = one.withColumn("_cap", F.col("source_size") * F.lit(CAP)).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    rising = Window.orderBy("_ratio", "_at")
    capped = F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weights = F.sum("_weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy())
    one = one.withColumn("_level", (everything * F.lit(SHARE) - capped) / weights)
    level = F.max(F.when(F.col("_level") < F.col("_ratio"), F.col("_level"))).over(Window.partitionBy())
    start = F.sum("source_size").over(Window.orderBy(F.asc_nulls_first("source")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("source_size")
    return one.select("source", "source_size", F.least(F.col("_cap"), level * F.col("_weight")).alias("target"), "tilt", start.alias("_start"))


def _time(tokens: Column) -> Column:
    """When the source's demand reaches so many tokens: the inverse of ((1 + tilt) * t - tilt * t * t) * target."""
    y, a = tokens / F.col("target"), F.col("tilt")
    return F.when(a == 0, y).otherwise((1 + a - F.sqrt((1 + a) * (1 + a) - 4 * a * y)) / (2 * a))


def mix(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size (words), source, source_size, target, taken (words, repeats counted), position and again (times from 0 to 1 of the first and second
    take, else null) for every row of docs, range-sorted by position.

    Documents of a source come in order of the MD5 of their id, the same in every run; whole rounds of the source are taken, then its beginning up to the target, so that taken sums
    to the target's whole part and at most one document of a source is cut. A null or blank text has size 0 and takes nothing; a null source is a source of its own, the last; a null doc_id
    is carried on; repeated rows are rows of their own. Empty tables give no rows. The columns in carry go along with their rows; others are not read.
    """
    # staged, as the range partitioning reads it twice
    sized = staged(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *carry), "mix").withColumn("_hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    placed = running_total(sized, ["source", "_hash", "doc_id", "size"], "size", "_before")
    wanted = targets(sized).withColumnRenamed("source", "_source")
    rows = placed.join(wanted, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_before", F.col("_before") - F.col("_start"))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("_rounds", rounds).withColumn("_part", F.floor(F.col("target") - F.col("_rounds") * F.col("source_size")))
    left = F.least(F.greatest(F.col("_part") - F.col("_before"), F.lit(0)), F.col("size"))
    rows = rows.withColumn("_left", left).withColumn("taken", (F.col("_rounds") * F.col("size") + F.col("_left")).cast("long"))
    whole = F.when(F.col("size") > 0, F.col("_rounds") + F.when(F.col("_left") > 0, 1).otherwise(0)).otherwise(0)
    first = F.when(whole >= 1, _time(F.col("_before").cast("double")))
    second = F.when(whole >= 2, _time((F.col("_before") + F.col("source_size")).cast("double")))
    out = rows.select("doc_id", "size", "source", "source_size", "target", "taken", first.alias("position"), second.alias("again"), *carry)
    return out.orderBy(F.asc_nulls_last("position"), "doc_id")
