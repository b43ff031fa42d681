"""Exact top-k search by BM25 with an inverted index and block-max WAND pruning.

Documents are dealt to shards of bounded size, like ones together. A shard is one self-contained row of flat arrays on shared files: its words' hashes, a
posting list for each, and the lengths and ids of its documents, again with like ones side by side. Document frequencies, the number of documents and their mean
length are added up over all shards, so a shard scores as one index over everything would, and its best k merge exactly.

A query first meets the shard of its own kind, then a few others, then four times as many, and so on. The k-th best score so far is the floor for the shards to come: one whose
words' upper bounds together can't reach it is passed by, and others return only what reaches it. Within a shard the blocks of all lists end at the same documents, so the cursors of a query's lists
move from block to block together: the sum of the lists' block maxima says whether a block can hold a document that reaches the k-th best score (a pivot); all blocks up to the next
pivot are skipped, and its documents are scored. Where nothing is known of that score yet, the most promising blocks are scored first, which raises it for the others. Rare words' lists are added up by document, and the
maxima of these sums are block maxima too; the sums of the common words' maxima of all blocks are one product of the queries' weights and the maxima. Final scores are computed in double precision, word by word in one fixed order, so equal texts tie exactly.

Queries come in blocks of bounded size, like ones together, each broadcast to the shards in turn. A shard answers many queries at once: the impacts of its common words in some blocks times
the weights of those of the queries that have a pivot among them are one product of matrices.
"""

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import running_total, staged
from .near_dedup import WordHashes

K = 10
K1, B = 1.2, 0.75
#: Bytes of text in a shard, words of all queries in a block, documents in a block of a shard: they bound a task's memory and what is broadcast.
SHARD = 10 << 20
QUERY_WORDS = 4_000_000
BLOCK = 32
#: A word is common in a shard if more than one document in so many has it.
COMMON = 16
#: Queries that a shard answers together, at most; pairs of one of them and a document, if there are more queries than one; blocks that are scored by one product; postings of rare words that are added up at once, but those of one query at least.
TOGETHER, CELLS, GROUP, POSTINGS = 256, 1 << 21, 8, 1 << 16
#: Common words whose postings are laid out at once.
ROWS = 64
#: Pivot blocks that are scored before the score to be reached is first raised. ORDER: words that documents are ordered by.
STEP, ORDER = 4, 24
#: What a query counts in a block besides its words, so that a block has a bounded number of queries too.
EACH = 100
#: Documents that the dealing of documents to shards is fitted on, for each shard and in all. It has no influence on results.
SAMPLE, SAMPLES = 100, 200_000
#: Shards in the first round after a query's own; each round has four times as many.
FIRST = 4
#: Bounds are in single precision; this makes up for their rounding.
SLACK = 1 + 1e-4

_INDEX = "shard int, words binary, df binary, docs binary, tf binary, lengths binary, ids binary, named binary"
_U64 = np.uint64


def word_hashes(text: str | None, seen: WordHashes) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").lower().split()
    return np.fromiter(map(seen.__getitem__, words), _U64, len(words))


def small(values: np.ndarray) -> bytes:
    """Counts as a byte each; those from 255 on come behind all others as integers of four."""
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype(np.uint32).tobytes()


def large(data: bytes, n: int) -> np.ndarray:
    """The n counts of small()."""
    out = np.frombuffer(data, np.uint8, n).astype(np.int32)
    out[out == 255] = np.frombuffer(data[n:], np.uint32)
    return out


def build_shard(found: list[tuple[np.ndarray, np.ndarray]], ids: list[int | None]) -> dict[str, bytes]:
    """The arrays of one shard from each document's distinct words and their counts. ids: null ids become 0, and a bit for each document says whether it has one."""
    sizes = np.array([len(w) for w, _ in found], np.int64)
    word = np.concatenate([w for w, _ in found]) if found else np.empty(0, _U64)
    tf = np.concatenate([c for _, c in found]).astype(np.int32, copy=False) if found else np.empty(0, np.int32)
    doc = np.repeat(np.arange(len(found), dtype=np.int32), sizes)
    by = np.argsort(word)
    word = word[by]
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.empty(0, np.int64)
    words, df = word[first], np.diff(first, append=len(word))
    del word
    doc, tf, at = doc[by], tf[by], np.repeat(np.arange(len(words), dtype=np.int32), df)
    del by
    # documents in order of which of the most frequent words they have: like ones come together, which keeps block maxima low
    rank = np.full(len(words), ORDER, np.int64)
    top = np.argsort(-df, kind="stable")[:ORDER]
    rank[top] = np.arange(len(top))
    has = np.zeros(len(found), np.int64)
    hit = rank[at] < ORDER
    np.add.at(has, doc[hit], np.int64(1) << (ORDER - 1 - rank[at][hit]))
    lengths = np.array([c.sum() for _, c in found], np.int64)
    order = np.lexsort((lengths, has))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    doc = place[doc]
    by = np.lexsort((doc, at))
    return {
        "words": words.tobytes(), "df": small(df), "docs": doc[by].astype(np.uint16 if len(found) <= 1 << 16 else np.uint32).tobytes(), "tf": small(tf[by]),
        "lengths": lengths[order].tobytes(), "ids": np.array([0 if i is None else i for i in ids], np.int64)[order].tobytes(),
        "named": np.packbits(np.array([i is not None for i in ids], bool)[order]).tobytes(),
    }


class Shard:
    """A shard with block maxima, ready for the words of a block of queries."""

    def __init__(self, row: dict[str, bytes], mean: float, vocabulary: np.ndarray):
        self.words = np.frombuffer(row["words"], _U64)
        self.starts = np.append(0, np.cumsum(large(row["df"], len(self.words)), dtype=np.int64))
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.n = len(self.ids)
        self.docs = np.frombuffer(row["docs"], np.uint16 if self.n <= 1 << 16 else np.uint32)
        tf = large(row["tf"], len(self.docs))
        self.tf = tf.astype(np.min_scalar_type(int(tf.max(initial=0))))
        self.norm = K1 * (1 - B + B * np.frombuffer(row["lengths"], np.int64) / max(mean, 1e-9))
        tf = self.tf.astype(np.float32)
        below = self.norm.astype(np.float32)[self.docs]
        below += tf
        tf *= np.float32(K1 + 1)
        tf /= below
        self.impact = tf
        del below
        at = np.searchsorted(self.words, vocabulary)
        at = np.minimum(at, max(0, len(self.words) - 1))
        known = self.words[at] == vocabulary if len(self.words) else np.zeros(len(vocabulary), bool)
        self.begin = np.where(known, self.starts[at], 0)
        self.end = np.where(known, self.starts[np.minimum(at + 1, len(self.starts) - 1)], 0)
        most = np.maximum.reduceat(self.impact, self.starts[:-1]) if len(self.words) else np.zeros(1, np.float32)
        self.limit = np.where(known, most[at], 0)  # of each word's impact here
        # common words have a dense row of impacts and one of block maxima
        self.blocks = -(-self.n // BLOCK)
        common = np.flatnonzero((self.end - self.begin) * COMMON > self.n)
        self.row = np.full(len(vocabulary), -1, np.int64)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        # all their postings, in order of (row, document)
        size = int((self.end[common] - self.begin[common]).sum())
        self.common_at = np.empty(size, np.min_scalar_type(len(self.docs)))
        self.common_key = np.empty(size, np.int32 if len(common) * self.n < 1 << 31 else np.int64)
        done = 0
        for start in range(0, len(common), ROWS):
            at, of = self.entries(common[start : start + ROWS])
            doc, of = self.docs[at], of + start
            self.dense[of, doc] = self.impact[at]
            self.common_at[done : done + len(at)], self.common_key[done : done + len(at)] = at, of * self.n + doc
            done += len(at)
        self.most = self.dense.reshape(len(common), self.blocks, BLOCK).max(axis=2) if self.n else np.zeros((0, 0), np.float32)
        self.by_id = np.argsort(self.ids, kind="stable")
        self.sorted_ids = self.ids[self.by_id]
        self.nameless = np.flatnonzero(np.unpackbits(np.frombuffer(row["named"], np.uint8), count=self.n) == 0)

    def entries(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all postings of some words, and for each the number of its word among them."""
        begin, size = self.begin[words], self.end[words] - self.begin[words]
        ends = np.cumsum(size)
        of = np.repeat(np.arange(len(words)), size)
        return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size), of

    def best(self, query: int, words: np.ndarray, weight: np.ndarray, k: int, floor: float) -> list[tuple[float, int]]:
        """(score, id) of the best k documents, of those that reach floor. words: places in the vocabulary, in rising order."""
        return self.best_of(np.array([query], np.int64), np.array([0, len(words)]), words, weight, k, np.array([floor], np.float64))[0]

    def best_of(self, ids: np.ndarray, ends: np.ndarray, words: np.ndarray, weight: np.ndarray, k: int, floors: np.ndarray) -> list[list[tuple[float, int]]]:
        """What best() gives for each of some queries. The words of query i and their weights are from ends[i] up to ends[i + 1]."""
        out: list[list[tuple[float, int]]] = [[] for _ in ids]
        of = np.repeat(np.arange(len(ids)), np.diff(ends))
        limit = np.bincount(of, weight * self.limit[words], minlength=len(ids))
        able = (limit > 0) & (limit * SLACK >= floors)
        asked = np.flatnonzero(able)
        if not len(asked):
            return out
        mine = able[of] & (self.end[words] > self.begin[words])
        of, words, weight, theta = (np.cumsum(able) - 1)[of[mine]], words[mine], weight[mine], floors[asked].copy()
        # rare lists are added up by document; common ones have a row of impacts and one of block maxima
        common = self.row[words] >= 0
        base = self._rare(of[~common], words[~common], weight[~common], len(asked))
        rows, column = np.unique(self.row[words[common]], return_inverse=True)
        factor = np.zeros((len(asked), len(rows)), np.float32)
        factor[of[common], column] = weight[common]
        a, b = np.searchsorted(self.sorted_ids, ids[asked]), np.searchsorted(self.sorted_ids, ids[asked], side="right")
        for q in np.flatnonzero(b > a):
            base[q, self.by_id[a[q] : b[q]]] = -np.inf
        base[:, self.nameless] = -np.inf
        reach = (base.reshape(len(asked), self.blocks, BLOCK).max(axis=2) + factor @ self.most[rows]) * np.float32(SLACK)
        for q in np.flatnonzero(theta <= 0):  # the most promising blocks first, so that much can be skipped
            top = np.argpartition(-reach[q], STEP)[:STEP] if self.blocks > STEP else np.arange(self.blocks)
            docs, used = (top[:, None] * BLOCK + np.arange(BLOCK)).ravel(), np.flatnonzero(factor[q])
            found = base[q, docs] + factor[q, used] @ self.dense[np.ix_(rows[used], docs)]
            theta[q] = max(theta[q], _kth(found[found > 0], k))
        pivot = (reach >= theta[:, None]) & (reach > 0)
        left, parts = np.flatnonzero(pivot.any(axis=0)), []
        for start in range(0, len(left), GROUP):  # a product for some blocks and all queries that have a pivot among them
            now = left[start : start + GROUP]
            who, docs = np.flatnonzero(pivot[:, now].any(axis=1)), (now[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            found = factor[who] @ self.dense[np.ix_(rows, docs)]
            found += base[np.ix_(who, docs)]
            q, d = np.nonzero((found >= (theta[who] / SLACK)[:, None].astype(np.float32)) & (found > 0))
            parts.append((who[q], docs[d], found[q, d]))
        who, docs, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3
        order = np.argsort(who, kind="stable")
        who, docs, score = who[order], docs[order], score[order]
        for q in np.unique(who):
            a, b = np.searchsorted(who, [q, q + 1])
            live = docs[a:b][score[a:b] * SLACK >= max(theta[q], _kth(score[a:b], k))]
            c, d = np.searchsorted(of, [q, q + 1])
            exact = self._exact(words[c:d], weight[c:d], live)
            order = np.lexsort((self.ids[live], -exact))
            out[asked[q]] = [(float(exact[j]), int(self.ids[live[j]])) for j in order[:k] if exact[j] > 0 and exact[j] * SLACK >= floors[asked[q]]]
        return out

    def _rare(self, of: np.ndarray, words: np.ndarray, weight: np.ndarray, queries: int) -> np.ndarray:
        """A row for each query: what some words, those of query of[i], add to each document's score. of is in rising order."""
        width, factor = self.blocks * BLOCK, weight.astype(np.float32)
        base = np.zeros((queries, width), np.float32)
        before = np.cumsum(size := self.end[words] - self.begin[words]) - size
        first = np.searchsorted(of, np.arange(queries + 1))
        group = np.append(before, 0)[np.minimum(first[:-1], len(before))] // POSTINGS if len(of) else np.zeros(queries, np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), queries]
        for q, r in zip(cuts, cuts[1:]):
            a, b = first[q], first[r]
            at, which = self.entries(words[a:b])
            place = self.docs[at] + ((of[a:b] - q) * width)[which]
            base[q:r] = np.bincount(place, factor[a:b][which] * self.impact[at], minlength=(r - q) * width).reshape(r - q, width)
        return base

    def _exact(self, words: np.ndarray, weight: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Scores of a few documents in double precision, added word by word."""
        place = np.full(self.n, -1, np.int64)
        place[live] = np.arange(len(live))
        total = np.zeros(len(live))
        common = self.row[words] >= 0
        at, of = self.entries(words[~common])
        mine = place[self.docs[at]] >= 0
        at, of = at[mine], np.flatnonzero(~common)[of[mine]]
        rows = self.row[words[common]]
        which, spot = np.nonzero(self.dense[np.ix_(rows, live)])
        near = self.common_at[np.searchsorted(self.common_key, (rows[which] * self.n + live[spot]).astype(self.common_key.dtype))]
        at, of = np.append(at, near), np.append(of, np.flatnonzero(common)[which])
        order = np.argsort(of, kind="stable")
        at, of = at[order], of[order]
        tf, doc = self.tf[at].astype(np.float64), self.docs[at]
        np.add.at(total, place[doc], weight[of] * (tf * (K1 + 1) / (tf + self.norm[doc])))
        return total


def _kth(score: np.ndarray, k: int) -> float:
    """The k-th best partial score: no document's full score is lower than its partial one, so this is a lower bound."""
    return float(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 0.0


def _few(batches, n: int = 256):
    """The same rows, a few at a time, so that a task holds few documents' words whatever the batches are."""
    for b in batches:
        for start in range(0, b.num_rows, n):
            yield b.slice(start, n)


def _kinds(found: np.ndarray, top: np.ndarray) -> int:
    """Which of the most frequent words a document has, as bits, the most frequent one first."""
    return sum(1 << (len(top) - 1 - int(i)) for i in np.flatnonzero(np.isin(top, found)))


def _sampled(docs: DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words of a bounded sample, and the kinds of its documents that cut it into even ranges."""
    n, wanted = docs.count(), min(SAMPLES, SAMPLE * shards)
    part = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 20)) < max(1, (wanted << 20) // max(1, n)))

    def words(batches):
        seen = WordHashes()
        for b in _few(batches):
            found = [np.unique(word_hashes(t.as_py(), seen)) for t in b.column("text")]
            yield pa.record_batch([pa.array([w.view(np.int64) for w in found], pa.list_(pa.int64()))], names=["words"])

    part = staged(part.select("text").mapInArrow(words, "words array<long>"), "search-sample")
    top = part.select(F.explode("words").alias("word")).groupBy("word").count().orderBy(F.desc("count"), "word").limit(ORDER).toArrow()["word"].to_numpy().view(_U64)
    bits = [F.when(F.array_contains("words", int(w)), 1 << (len(top) - 1 - i)).otherwise(0) for i, w in enumerate(top.view(np.int64))]
    kind = sum(bits[1:], bits[0]) if bits else F.lit(0)
    kinds = np.sort(part.select(kind.cast("long").alias("kind")).toArrow()["kind"].to_numpy())  # SAMPLES rows, about, at most
    ranges = max(1, min(shards, len(kinds) // 10))
    return top, kinds[np.arange(1, ranges) * len(kinds) // ranges]


def prepare(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """doc_id, shard, words and counts of every row. Documents of one kind that are too many for a shard are dealt out by hash."""
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = int(size // shard) + 1
    top, bounds = _sampled(docs, shards) if shards > 1 else (np.empty(0, _U64), np.empty(0, np.int64))
    fold = -(-shards // (len(bounds) + 1))  # shards a range, where there are more than ranges

    def run(batches):
        seen = WordHashes()
        for b in _few(batches):
            found = [np.unique(word_hashes(t.as_py(), seen), return_counts=True) for t in b.column("text")]
            kind = np.array([_kinds(w, top) for w, _ in found], np.int64)
            low, high = np.searchsorted(bounds, kind, side="left"), np.searchsorted(bounds, kind, side="right")
            deal = b.column("deal").to_numpy().view(_U64)
            at = (low + (deal % (high - low + 1).astype(_U64)).astype(np.int64)) * fold + ((deal >> _U64(32)) % _U64(fold)).astype(np.int64)
            columns = [b.column("doc_id"), pa.array(at, pa.int32()), pa.array([w.tobytes() for w, _ in found], pa.binary()), pa.array([small(c) for _, c in found], pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "shard", "words", "counts"])

    deal = F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).alias("deal")
    return staged(docs.select(F.col("doc_id").cast("long"), "text", deal).mapInArrow(run, "doc_id long, shard int, words binary, counts binary"), "search-words")


def _build(key, table):
    found = [(np.frombuffer(w.as_buffer(), _U64), large(c.as_py(), w.as_buffer().size // 8)) for w, c in zip(table["words"], table["counts"], strict=True)]
    row = build_shard(found, table["doc_id"].to_pylist())
    return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in row.values())], names=["shard", *row])


def build_index(prepared: DataFrame) -> DataFrame:
    """A row for each shard, on shared files. Row groups are of about one shard, so that a reader holds one at a time."""
    return staged(prepared.groupBy("shard").applyInArrow(_build, _INDEX), "search-index", {"parquet.block.size": 1 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1})


def _lengths(batches):
    for b in batches:
        found = [np.frombuffer(x.as_py(), np.int64) for x in b.column("lengths")]
        yield pa.record_batch([pa.array([len(x) for x in found], pa.int64()), pa.array([int(x.sum()) for x in found], pa.int64())], names=["n", "total"])


def search(index: DataFrame, queries: DataFrame, k: int = K, block: int = QUERY_WORDS) -> DataFrame:
    """query_id, rank, doc_id and score of the best k documents of an index for each row of queries, which are rows of prepare().

    The score is the sum over the query's distinct words of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean length)). Words are runs without
    ASCII white space after lower-casing A-Z, told apart by 64-bit hashes. Documents with the query's own id or without an id are left out, as are those of score 0; ties go to the smaller id. Documents
    without words count in the statistics. A query without words, or of null id, gives no rows; of several queries of one id the one whose words come first by their bytes is asked; repeated documents each have a rank.
    """
    n, total = (x or 0 for x in index.select("lengths").mapInArrow(_lengths, "n long, total long").agg(F.sum("n"), F.sum("total")).first())
    mean = total / n if n else 0.0
    asked = queries.where(F.col("doc_id").isNotNull() & (F.octet_length("words") > 0)).groupBy(F.col("doc_id").alias("query_id")).agg(F.min(F.struct("words", "shard")).alias("_of"))
    asked = asked.select("query_id", "_of.shard", "_of.words", (F.octet_length("_of.words") / 8 + EACH).cast("long").alias("_n"))
    asked = running_total(staged(asked, "search-queries"), ["shard", "query_id"], "_n", "_before").withColumn("_block", F.floor(F.col("_before") / block))
    asked = staged(asked.select("query_id", "shard", "words", "_block"), "search-blocks")
    last = asked.agg(F.max("_block")).first()[0]
    shards = index.agg(F.max("shard")).first()[0]
    found = [_block(index, shards + 1, asked.where(F.col("_block") == i), n, mean, k) for i in range(last + 1)] if last is not None else []
    out = found[0] if found else index.sparkSession.createDataFrame([], "query_id long, doc_id long, score double")
    for df in found[1:]:
        out = out.union(df)
    return _best(out, k).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


@contextmanager
def _one_by_one(spark: SparkSession):
    """While it lasts, jobs hand rows to Python one at a time, as a row of the index is megabytes: else a batch holds 64 MB of them on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 1)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _block(index: DataFrame, shards: int, asked: DataFrame, n: int, mean: float, k: int) -> DataFrame:
    """What the shards return for a block of queries, which has about QUERY_WORDS words at most and those of one query besides."""
    context = index.sparkSession.sparkContext
    table = asked.select("query_id", "shard", "words").toArrow().combine_chunks().sort_by([("shard", "ascending"), ("query_id", "ascending")])
    ids, home = table["query_id"].to_numpy(), table["shard"].to_numpy()
    lists = [np.frombuffer(w.as_py(), _U64) for w in table["words"]]
    ends = np.concatenate([[0], np.cumsum([len(w) for w in lists])])
    vocabulary, at = np.unique(np.concatenate(lists), return_inverse=True)
    at, by_id = at.astype(np.int32), np.argsort(ids)
    known = context.broadcast(vocabulary)

    def count(batches):
        for b in batches:
            for own, df in zip(b.column("words"), b.column("df"), strict=True):
                own = np.frombuffer(own.as_py(), _U64)
                _, here, there = np.intersect1d(own, known.value, assume_unique=True, return_indices=True)
                yield pa.record_batch([pa.array(there, pa.int64()), pa.array(large(df.as_py(), len(own))[here], pa.int64())], names=["word", "df"])

    counts = index.select("words", "df").mapInArrow(count, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(vocabulary))
    df[counts["word"].to_numpy()] = counts["df"].to_numpy()
    weights = context.broadcast((ids, home, ends, at, np.log1p((n - df + 0.5) / (df + 0.5))))
    floors = np.zeros(len(ids))

    def run(floors, at_home):
        shared = context.broadcast(floors)

        def task(batches):
            ids, home, ends, at, weight = weights.value
            floors = shared.value.copy()
            heaps: dict[int, list[tuple[float, int]]] = {}  # the best so far in this task, of all its shards
            for b in batches:
                for i in range(b.num_rows):
                    number = b.column("shard")[i].as_py()
                    shard = Shard({c: b.column(c)[i].as_py() for c in b.schema.names if c != "shard"}, mean, known.value)
                    due, few = np.flatnonzero((home == number) == at_home), max(1, min(TOGETHER, CELLS // max(1, shard.n)))
                    for some in (due[start : start + few] for start in range(0, len(due), few)):
                        own = np.concatenate([at[ends[q] : ends[q + 1]] for q in some])
                        best = shard.best_of(ids[some], np.append(0, np.cumsum(ends[some + 1] - ends[some])), own, weight[own], k, floors[some])
                        for q, more in zip(some.tolist(), best, strict=True):
                            if more:
                                heaps[q] = sorted([*heaps.get(q, ()), *((-s, doc) for s, doc in more)])[:k]
                                if len(heaps[q]) == k:
                                    floors[q] = max(floors[q], -heaps[q][-1][0])
            out = [(int(ids[q]), doc, -s) for q, heap in heaps.items() for s, doc in heap if -s * SLACK >= floors[q]]
            for start in range(0, len(out), 10_000):
                yield pa.record_batch([pa.array([o[j] for o in out[start : start + 10_000]], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "doc_id", "score"])

        return task

    found, begin, size = None, -1, FIRST
    while begin < shards:  # first each query's own shard, then the others, in growing rounds
        if found is not None and begin > -1:
            least = _best(found, k).where(F.col("rank") == k).select("query_id", "score").toArrow()  # a row a query at most
            floors[by_id[np.searchsorted(ids, least["query_id"].to_numpy(), sorter=by_id)]] = least["score"].to_numpy()
        first, end = (int(home[0]), int(home[-1]) + 1) if begin < 0 else (begin, begin + size)  # queries are in order of their shards
        some = index.where((F.col("shard") >= first) & (F.col("shard") < end))
        with _one_by_one(index.sparkSession):
            more = staged(some.mapInArrow(run(floors.copy(), begin < 0), "query_id long, doc_id long, score double"), "search-found")
        found = more if found is None else found.union(more)
        begin, size = (0, FIRST) if begin < 0 else (begin + size, 4 * size)
    return found


def topk_search(docs: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """Searches for every row whose id is divisible by `every`, against all rows of docs. See search()."""
    prepared = prepare(docs)
    return search(build_index(prepared), prepared.where(F.col("doc_id") % every == 0), k)
