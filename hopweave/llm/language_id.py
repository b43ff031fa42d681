"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of character n-grams (n from 1 to 3, lower-cased, hashed to 2 ** BITS features) that both
contain, over the root of the product of their own numbers. Landmark texts span a Nyström map of the kernel; one-versus-rest ridge
regression on that map gives a score for each language. A batch of texts is scored by matrix products: its presence matrix, times that of the landmarks, times the
weights. The last two are multiplied once, when the model is fitted, so that a model has a row a feature and a column a language, however many landmarks there are.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BITS = 16
GRAMS = 3
#: The training sample: so many rows of each language at most, fewer where there are so many languages that SAMPLE rows don't do, but LEAST each. Every language has a class.
ROWS, SAMPLE, LEAST = 200, 12_800, 20
#: Landmarks of each language at most, and in all, but one each.
LANDMARKS, MARKS = 24, 512
RIDGE = 1e-2

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_STEP = 1 << 16


def presence(text: str) -> np.ndarray:
    """Which features the whole text has, as booleans."""
    found = np.zeros(1 << BITS, bool)
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    for start in range(0, len(code), _STEP):  # long texts in steps that overlap, so that memory is bounded
        part = code[start : start + _STEP + GRAMS - 1].astype(np.uint64)
        mixed = np.zeros(len(part), np.uint64)
        for n in range(GRAMS):
            if len(part) > n:
                mixed = mixed[: len(part) - n] * _MIX[0] + (part[n:] + np.uint64(1)) * _MIX[1]
                found[(mixed * _MIX[2]) >> np.uint64(64 - BITS)] = True
    return found


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


#: Rows whose features are spread out at a time.
BLOCK = 256


class KernelRidge:
    """One-versus-rest kernel ridge regression on the Nyström map of the landmarks. packed: the features of each row as bits."""

    def __init__(self, packed: list[bytes], langs: list[str]):
        bits = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        root = np.sqrt(np.maximum(1, np.bitwise_count(bits).sum(axis=1, dtype=np.int64)))
        self.classes = sorted(set(langs))
        each = max(1, min(LANDMARKS, MARKS // len(self.classes)))
        marks, seen = [], dict.fromkeys(self.classes, 0)
        for i, lang in enumerate(langs):
            if seen[lang] < each:
                seen[lang] += 1
                marks.append(i)
        spread = lambda rows: np.unpackbits(bits[rows], axis=1).astype(np.float32)
        blocks = [marks[i : i + BLOCK] for i in range(0, len(marks), BLOCK)]
        kernel = np.empty((len(langs), len(marks)), np.float32)
        at = 0
        for block in blocks:
            side = spread(block).T
            for i in range(0, len(langs), BLOCK):
                rows = slice(i, i + BLOCK)
                kernel[rows, at : at + len(block)] = spread(rows) @ side / root[rows, None] / root[block]
            at += len(block)
        self.landmarks = len(marks)
        values, vectors = np.linalg.eigh(kernel[marks].astype(np.float64))
        good = values > 1e-6 * values[-1]
        span = vectors[:, good] / np.sqrt(values[good])
        x = np.hstack([kernel @ span, np.ones((len(langs), 1))])
        number = {c: k for k, c in enumerate(self.classes)}
        own = np.array([number[x] for x in langs])
        weight = 1 / np.bincount(own)[own]  # each language weighs the same
        y = np.where(own[:, None] == np.arange(len(self.classes)), 1.0, -1.0)
        solved = np.linalg.solve(x.T @ (x * weight[:, None]) + RIDGE / len(self.classes) * np.eye(x.shape[1]), x.T @ (y * weight[:, None]))
        self.bias = solved[-1]
        weights, at = (span @ solved[:-1] / root[marks, None]).astype(np.float32), 0
        folded = np.zeros((bits.shape[1] * 8, len(self.classes)), np.float32)
        for block in blocks:
            folded += spread(block).T @ weights[at : at + len(block)]
            at += len(block)
        self.features = np.flatnonzero(folded.any(axis=1))
        self.weights = folded[self.features]

    def predict(self, grams: np.ndarray, sizes: np.ndarray) -> tuple[list[str], np.ndarray]:
        """grams: for each text which of self.features it has; sizes: how many features it has in all. Of languages that tie the first by name is taken."""
        margin = grams.astype(np.float32) @ self.weights / np.sqrt(np.maximum(1, sizes))[:, None] + self.bias
        best = margin.argmax(axis=1)
        return [self.classes[i] for i in best], np.clip((margin[np.arange(len(best)), best] + 1) / 2, 0, 1)


def fit(docs: DataFrame) -> KernelRidge | None:
    """Fits on a bounded sample of the rows with a language and a letter: those of least hash, the same for each language. Rows of one id and text count once. None without such rows."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text", F.xxhash64("text").alias("_print"))

    def lettered(batches):
        for b in batches:
            yield b.select(["doc_id", "lang", "_print"]).filter(pa.array([has_letter(t.as_py()) for t in b.column("text")], pa.bool_()))

    useful = staged(rows.mapInArrow(lettered, rows.drop("text").schema).distinct(), "language-rows")
    rows_each = min(ROWS, max(LEAST, SAMPLE // max(1, useful.select("lang").distinct().count())))
    least = Window.partitionBy("lang").orderBy("_hash", "doc_id", "_print")
    picked = useful.select("lang", "doc_id", "_print", F.xxhash64("doc_id").alias("_hash")).withColumn("_at", F.row_number().over(least)).where(F.col("_at") <= rows_each)
    ids = picked.select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_id"), F.col("_print").alias("_same"))  # SAMPLE rows at most, or LEAST a language

    def pack(batches):
        for b in batches:
            out = [(doc, lang, np.packbits(presence(text)).tobytes()) for doc, lang, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True) if has_letter(text)]
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary()))], names=["doc_id", "lang", "grams"])

    same = (F.col("lang") == F.col("_lang")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_same"))
    one = rows.join(F.broadcast(ids), same, "left_semi").dropDuplicates(["doc_id", "lang", "_print"])
    sample = one.select("doc_id", "lang", "text").mapInArrow(pack, "doc_id long, lang string, grams binary").toArrow().to_pylist()
    sample.sort(key=lambda r: (r["lang"], r["doc_id"] is not None, r["doc_id"] or 0, r["grams"]))
    return KernelRidge([r["grams"] for r in sample], [r["lang"] for r in sample]) if sample else None


def identify(docs: DataFrame, model: KernelRidge | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row; lang_pred is `und` with score 0 if the text is null or has no letter, or if there is no model.

    Only the text is read; of languages that tie the first by name is taken. Repeated rows give the same again; null ids are carried on; empty tables give no rows. The columns in carry go along with their rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))

    def run(batches):
        model = None
        if shared.value:
            model = object.__new__(KernelRidge)
            vars(model).update(shared.value)
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text")
            known = [None] * len(ids)
            rows, sizes, at = [], [], []

            def score():
                if rows:
                    for i, lang, s in zip(at, *model.predict(np.array(rows), np.array(sizes)), strict=True):
                        known[i] = (lang, float(s))
                    rows.clear(), sizes.clear(), at.clear()

            for i in range(len(ids)):
                text = texts[i].as_py()
                if model is None or not has_letter(text):
                    known[i] = ("und", 0.0)
                    continue
                found = presence(text)
                rows.append(found[model.features])
                sizes.append(int(np.count_nonzero(found)))
                at.append(i)
                if len(rows) == 256:
                    score()
            score()
            yield pa.record_batch([ids.cast(pa.int64()), pa.array([k[0] for k in known], pa.string()), pa.array([k[1] for k in known], pa.float64()), *(b.column(c) for c in carry)], names=["doc_id", "lang_pred", "score", *carry])

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*dict.fromkeys(("doc_id", "text", *carry))).mapInArrow(run, "doc_id long, lang_pred string, score double" + kinds)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 1 when divided by 3. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def language_id(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, and its columns in carry, by a model that learns from the rows that aren't held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model, carry).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", *carry)
