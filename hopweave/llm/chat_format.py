"""Chat formatting by perspective rotation, with DataFrame operations only.

Every participant of a dialogue gets a rendering in which that speaker is the assistant, all others are users by name, and only the speaker's
own words are trained on. System turns stay system turns in every rendering and no participant's own.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A rendering is stored in pieces: turns with numbers in the same stretch of so many, and of them so many rows, make one row, so that no row grows with a
#: conversation. A dialogue isn't cut by this: the pieces in order are the whole rendering, and each tells where in it it begins.
STRETCH = 64
ROWS = 256
#: The chat format.
OPEN, NAME, CLOSE = "<|im_start|>", " name=", "<|im_end|>\n"


def _render(turn: Column, speaker: Column) -> Column:
    """(text, head length, own) of one turn for one speaker."""
    own = turn["role"] == speaker
    head = F.when(own, F.lit(f"{OPEN}assistant\n")).when(turn["role"] == "system", F.lit(f"{OPEN}system\n")).otherwise(F.concat(F.lit(f"{OPEN}user{NAME}"), turn["role"], F.lit("\n")))
    return F.struct(F.concat(head, turn["text"], F.lit(CLOSE)).alias("text"), F.length(head).alias("head"), own.alias("own"))


def _masks(turns: Column) -> Column:
    """[start, end) of the own words in characters of the rendering, the closing mark included."""

    def step(acc, t):
        end = acc["at"] + F.length(t["text"])
        span = F.array(F.struct((acc["at"] + t["head"]).alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, stretch, piece, begins, n_turns, n_own, rendered and masks (array of start and end) for every participant and piece of each conversation.

    A participant's rendering of the dialogue is `rendered` of its pieces one after another, in order of stretch (null last) and piece; begins is the number of characters before a
    piece, so masks of the whole are those of the pieces plus begins. There are as many rows as pieces times participants.

    Rows of a conversation are ordered by turn (null last), role and text; repeated rows are turns of their own. A null role is a nameless speaker, shown as user `unknown` and
    never the assistant; a null text is an empty one; rows of null conv_id are one conversation. System is no participant, so a conversation of system turns only gives no rows, as does an empty table.
    Texts of any length are kept whole. A participant without a turn in a stretch still gets its rendering, with no masks. Other columns are not read.
    """
    stretch = F.floor(F.col("turn") / STRETCH)
    rows = turns.select(
        F.coalesce("conv_id", F.lit(0)).alias("_conv"), F.col("conv_id").isNull().alias("_none"), F.coalesce(stretch, F.lit(0)).alias("_stretch"), stretch.isNull().alias("_late"), "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"), F.col("role").isNull().alias("nameless"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("_conv", "_none", "_stretch", "_late").orderBy(F.asc_nulls_last("turn"), "role", "text")
    rows = rows.withColumn("_at", F.row_number().over(order)).withColumn("piece", F.floor((F.col("_at") - 1) / ROWS))
    one = ["_conv", "_none", "_stretch", "_late", "piece"]
    pieces = rows.groupBy(*one).agg(F.array_sort(F.collect_list(F.struct("_at", "role", "text"))).alias("turns"))
    # where pieces begin, by lengths alone: own turns have another head than those of others
    named = rows.where(~F.col("nameless") & (F.col("role") != "system")).withColumnRenamed("role", "speaker")
    head = F.when(F.col("role") == "system", len(f"{OPEN}system\n")).otherwise(len(f"{OPEN}user{NAME}\n") + F.length("role"))
    long = rows.groupBy(*one).agg(F.sum((head + F.length("text") + len(CLOSE)).cast("long")).alias("_long"))
    own = named.groupBy(*one, "speaker").agg(F.count("*").alias("_own"))
    views = long.join(named.select("_conv", "_none", "speaker").distinct(), ["_conv", "_none"]).join(own, [*one, "speaker"], "left")
    length = F.col("_long") - F.coalesce("_own", F.lit(0)) * (len(f"user{NAME}") + F.length("speaker") - len("assistant"))
    before = Window.partitionBy("_conv", "_none", "speaker").orderBy("_late", "_stretch", "piece").rowsBetween(Window.unboundedPreceding, -1)
    views = views.select(*one, "speaker", F.coalesce(F.sum(length).over(before), F.lit(0)).alias("begins"))
    out = pieces.join(views, one).withColumn("turns", F.transform("turns", lambda t: _render(t, F.col("speaker"))))
    return out.select(
        F.when(~F.col("_none"), F.col("_conv")).alias("conv_id"), "speaker", F.when(~F.col("_late"), F.col("_stretch")).alias("stretch"), "piece", "begins",
        F.size("turns").cast("long").alias("n_turns"), F.size(F.filter("turns", lambda t: t["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("rendered"), _masks(F.col("turns")).alias("masks"),
    )
