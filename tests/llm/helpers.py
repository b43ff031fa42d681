"""Small tables with the cases that the operators must handle."""

import random
import re

from pyspark.sql import DataFrame, SparkSession

WORDS = re.compile("[^\x20\x09-\x0d]+")
_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; extra columns may have them.
CLASHES = ("_id", "key", "_key", "bucket", "shard", "size", "_hash", "band", "chunk", "train", "_text", "n", "target", "rank", "speaker", "_at", "text_sha256", "component")


def low(text: str | None) -> str:
    return (text or "").translate(_AZ)


def words(text: str | None) -> list[str]:
    return WORDS.findall(low(text))


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """Made-up documents with copies, near copies, ties, nulls, empty, odd and very long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    out = []
    for i in range(n):
        out.append((i, prose(rng.choice((3, 12, 40, 90))), rng.choice(("en", "de", None)), rng.choice(("src0", "src0", "src1", "src2", None)), 1))
    base = prose(120).split(" ")
    for i in range(12):  # near copies
        own = list(base)
        for _ in range(i % 4):
            own[rng.randrange(len(own))] = "changed"
        out.append((100 + i, " ".join(own), "en", "src0", 2))
    for i in range(9):  # copies up to case
        out.append((200 + i, "The SAME text, again" if i % 2 else "the same text, again", "en", "src1", 3))
    odd = [None, "", "  \t\n ", "word", "WORD", "two words", "\x00nul \x1f unit", "a b c　d", "İSTANBUL ΣΣ ß", "é é 한글", "<|endoftext|>mid<|startoftext|> <|endoftext|>", "\U0001f600\U0001f469‍\U0001f52c 12'345 don't", "All Rights Reserved. CC-BY cc by, General public-license", "123 456 !!!", prose(30_000), "x" * 5000]
    for i, text in enumerate(odd):
        out.append((300 + i, text, None if i % 3 else "de", None if i % 2 else "src2", None))
    out += [(300, None, None, None, None), (None, "no id", "en", "src0", 1), (None, None, None, None, None), (5, out[5][1], out[5][2], out[5][3], 1)]
    return out


def table(spark: SparkSession, data: list[tuple] | None = None, extra: bool = True) -> DataFrame:
    df = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in CLASHES})
    return df


def tuples(df: DataFrame, *columns: str) -> list[tuple]:
    found = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(found, key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, list) else (True, "", str(x)) for x in r))
