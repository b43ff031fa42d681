"""MinHash near-deduplication with odd sketches.

Documents with the same shingle set are one representative. SAMPLES MinHash values give BANDS band keys. BINS one-permutation MinHash values (the least
hash in each of BINS ranges) are folded into a parity bitmap, the representative's odd sketch: the population count of the XOR of two
sketches tells how many of the values differ, which estimates a high similarity closely. Documents that share a band key are
candidates; those whose sketches are near enough are compared on their full sets.

Pairs within a group are never all listed. First each member of a band's group is compared with the group's first member, and links make components. A group is done when
it has one component. In the others each member is next compared with the one beside it, in order of another band's key, a few times with different bands; large groups of copies
come together in this way by as many comparisons as they have members. For the groups that still have several components an exact filter ends the search: with each
member's shingles in order from rarest to most common, two linked sets share one within their first 20 %, early enough in both that what follows can still make up the
similarity. Texts that have a frequent passage in common and differ in the rest don't meet in this join.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

SAMPLES, BANDS = 128, 32
BINS, BITS = 512, 1024
#: Standard errors by which the sketches' estimate may fall short of 0.8; about one link at 0.8 in a million falls shorter.
ERRORS = 4.75
#: Bands by whose keys members are set side by side, in turn.
BESIDE = (5, 16, 27)
LONGS = BITS // 64

_RNG = np.random.default_rng(5)
_A = _RNG.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, SAMPLES, np.uint32)
_C = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; starts anew when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_set(text: str | None, width: int, seen: WordHashes) -> np.ndarray:
    """The distinct shingles of the whole text as sorted 64-bit hashes. bytes.lower and bytes.split know ASCII only, as is wanted."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    if len(words) < width:
        return mixed(reduce(lambda h, w: mixed(h + w), each, np.uint64(len(words)) * _C[:1]))
    wide = np.zeros(len(each) - width + 1, np.uint64)
    for k in range(width):
        wide = wide * _C[0] + mixed(each[k : len(each) - width + 1 + k] + _C[4])
    return np.unique(mixed(wide))


def minhash(found: np.ndarray) -> np.ndarray:
    high = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, ~np.uint32(0))
    for i in range(0, len(high), 1024):
        np.minimum(least, (high[i : i + 1024, None] * _A + _B).min(axis=0), out=least)
    return least


def odd_sketches(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each sorted set the parity of how many of the least hashes of BINS ranges fall on each of BITS places, as LONGS integers, and the number of ranges that have one."""
    every, of = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
    bin_ = (every >> np.uint64(64 - (BINS.bit_length() - 1))).astype(np.int64) + of * BINS
    first = np.flatnonzero(np.diff(bin_, prepend=-1))
    place = (mixed(every[first] * _C[3] + _C[0]) >> np.uint64(64 - (BITS.bit_length() - 1))).astype(np.int64)
    odd = np.bincount(of[first] * BITS + place, minlength=len(found) * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(found), LONGS), np.bincount(of[first], minlength=len(found))


def band_keys(samples: np.ndarray) -> np.ndarray:
    """A key for each band of each row of samples."""
    rows = samples.astype(np.uint64).reshape(len(samples), BANDS, SAMPLES // BANDS)
    key = np.arange(BANDS, dtype=np.uint64) * _C[4]
    for k in range(rows.shape[2]):
        key = mixed(key * _C[0] + rows[:, :, k])
    return key.view(np.int64)


def near_enough(bits, x, y, nx, ny, m=np):
    """Whether the estimated share of equal values is not too far under what a similarity of 0.8 gives. m: np for arrays, functions for Columns.

    bits: population count of the XOR; x, y: values folded into the sketches; nx, ny: sizes of the sets. At 0.8 the union has (nx + ny) / 1.8 shingles, which fill a known
    number of ranges. The variance is that of so many values drawn without repeats from the union, and that of their parities.
    """
    equal = (x + y + BITS / 2 * m.log(1 - 2 * bits / BITS)) / 2
    filled = lambda n: BINS * (1 - m.exp(-n / BINS))
    union = (nx + ny) / 1.8
    ranges = filled(union) * (x + y) / (filled(nx) + filled(ny))
    error = m.sqrt(0.16 * m.abs(1 - ranges / union) / ranges + 1e-4)
    return equal / ranges >= 0.8 - ERRORS * error - 0.5 / ranges


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        seen = WordHashes()
        for b in batches:
            ids, texts = b.column("doc_id").cast(pa.int64()), b.column("text")
            start = 0
            while start < len(ids):  # a few sets at a time, whatever their sizes
                sets, size = [], 0
                while start + len(sets) < len(ids) and len(sets) < 512 and size < 1 << 19:
                    sets.append(shingle_set(texts[start + len(sets)].as_py(), width, seen))
                    size += len(sets[-1])
                some = [s for s in sets if len(s)]
                bands = band_keys(np.array([minhash(s) for s in some])) if some else np.empty((0, BANDS), np.int64)
                sketches, marks = odd_sketches(some) if some else (np.empty((0, LONGS), np.int64), np.empty(0, np.int64))
                has = np.array([len(s) > 0 for s in sets])
                ends = np.append(0, np.cumsum(has))
                every = np.zeros(len(sets), np.int64)
                every[has] = marks
                lists = [pa.ListArray.from_arrays(pa.array(ends * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (bands, sketches)]
                columns = [ids.slice(start, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), *lists, pa.array(every)]
                yield pa.record_batch(columns, names=["doc_id", "n", "print", "bands", "sketch", "marks"])
                start += len(sets)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, print binary, bands array<long>, sketch array<long>, marks long")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        seen = WordHashes()
        for b in batches:
            sets = [shingle_set(t.as_py(), width, seen).view(np.int64) for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, set array<long>")


def _sized(a: str, b: str) -> Column:
    """Whether two set sizes allow a link."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return 100 * F.least(na, nb) >= 80 * F.greatest(na, nb)


def _near(a: str, b: str) -> Column:
    """Whether two sketches and set sizes allow a link."""
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(LONGS)])
    return _sized(a, b) & near_enough(bits, *(F.col(f"{t}.{c}") for c in ("marks", "n") for t in (a, b)), F)


def components(edges: DataFrame) -> DataFrame:
    """node and its component, the least node reachable, from edges (a, b). Labels go to neighbours and then jump to their label's label, each round on a new shared table."""
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(heard, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("upper"))
        after = staged(low.join(up, "component").select("node", F.least("component", "upper").alias("component"), "was"), "labels")
        labels = after.select("node", "component")
        if after.where(F.col("component") != F.col("was")).isEmpty():
            return labels


def near_dedup(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs. Two documents are linked when 100 * the intersection of their shingle sets is at least 80 * the union.

    Words are runs without ASCII white space after lower-casing A-Z; a text of fewer words than width is one shingle; a text without words, or null, has
    none and is linked with nothing. component_id is the smallest doc_id reachable, kept says that it is the row's own. Rows of one doc_id are one document. A row with null doc_id is linked with nothing:
    component_id is null, and it is kept. Empty tables give no rows. Other columns are not read.
    """
    signed = staged(_signatures(docs, width), "near-signed")
    usable = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = staged(usable.groupBy("print", "n").agg(F.min("doc_id").alias("rep"), F.first(F.struct("bands", "sketch", "marks")).alias("_of")).select("print", "n", "rep", "_of.*"), "near-reps")
    sketches = reps.select("rep", "n", "sketch", "marks")
    # groups of at least two; a member knows the first of its group
    banded = reps.select("rep", F.explode("bands").alias("band"))
    heads = banded.groupBy("band").agg(F.min("rep").alias("first"), F.count("*").alias("members")).where(F.col("members") > 1)
    groups = staged(banded.join(heads, "band"), "near-groups")
    # the full sets of all members, made once; a merge join at every size, as ids of all members may be too many to broadcast
    members = groups.select(F.col("rep").alias("doc_id")).distinct().hint("merge")
    sets = staged(_sets(docs.select("doc_id", "text").join(members, "doc_id", "left_semi"), width).dropDuplicates(["doc_id"]), "near-sets")
    pairs = groups.where(F.col("rep") != F.col("first")).select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    tried = staged(_near_pairs(pairs, sketches), "near-pairs")
    edges = _links(sets, tried)
    labels = components(edges)
    rest = groups.where(F.col("members") > 2).select("band", "rep")
    for turn in (*(lambda m, k=k: _beside(m, k) for k in BESIDE), lambda m: _near_pairs(_rarest(m, sets), sketches)):
        rest = staged(_open(rest, labels), "near-open")
        if rest.isEmpty():
            break
        more = staged(turn(rest.join(reps.drop("print"), "rep")).join(tried, ["a", "b"], "left_anti"), "near-pairs")
        if not more.isEmpty():
            tried = tried.union(more)
            found = _links(sets, more)
            if not found.isEmpty():
                edges = edges.union(found)
                labels = components(edges)
    nodes = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("print", "n", F.coalesce("component", "rep").alias("component"))
    found = signed.select("doc_id", "n", "print").join(nodes, ["print", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _near_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches are near enough."""
    both = pairs.join(sketches.alias("x"), F.col("a") == F.col("x.rep")).join(sketches.alias("y"), F.col("b") == F.col("y.rep"))
    return both.where(_near("x", "y")).select("a", "b")


def _open(rest: DataFrame, labels: DataFrame) -> DataFrame:
    """band, rep, component and main of the members of groups with several components; main is the largest one."""
    known = labels.withColumnRenamed("node", "rep")
    member = rest.select("band", "rep").join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    sizes = member.groupBy("band", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("band").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("parts")).where(F.col("parts") > 1)
    return member.join(largest, "band").select("band", "rep", "component", F.col("top.component").alias("main"))


def _beside(member: DataFrame, band: int) -> DataFrame:
    """Pairs of neighbours of different components, in order of the key of another band: those that share it too stand together. Where a range ends,
    neighbours are not compared; the last join finds what is missed."""
    order = ("band", "other", "n", "rep")
    rows = staged(member.select("band", F.col("bands")[band].alias("other"), "n", "rep", "component", "sketch", "marks"), "near-beside")

    def run(batches):
        last = None
        for b in batches:
            table = pa.Table.from_batches([b]) if last is None else pa.concat_tables([last, pa.Table.from_batches([b])])
            last = table.slice(max(0, len(table) - 1))
            if len(table) < 2:
                continue
            of = {c: table[c].to_numpy() for c in ("band", "n", "rep", "component", "marks")}
            sketch = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["sketch"].chunks]).view(np.uint64).reshape(-1, LONGS)
            bits = np.bitwise_count(sketch[1:] ^ sketch[:-1]).sum(axis=1, dtype=np.int64)
            x, y = of["n"][1:], of["n"][:-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                near = near_enough(bits, of["marks"][1:], of["marks"][:-1], x, y)
            sized = 100 * np.minimum(x, y) >= 80 * np.maximum(x, y)
            at = np.flatnonzero(near & sized & (of["band"][1:] == of["band"][:-1]) & (of["component"][1:] != of["component"][:-1]))
            one, two = of["rep"][at], of["rep"][at + 1]
            yield pa.record_batch([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])

    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long").distinct()


def _rarest(member: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of different components, one of the two outside its group's main one, that can be linked as far as their rarest shingles tell.

    Shingles are ordered by the number of members that have them. Of n shingles, linked sets share one among the first n - ceil(0.8 n) + 1 of both, and for the
    first that they share, as many must be left behind it as the intersection needs. A shingle that one member alone has counts for the order only.
    """
    nodes = staged(member.groupBy(F.col("rep").alias("doc_id"), "component").agg(F.max(F.col("component") != F.col("main")).alias("outside")), "near-nodes")
    each = sets.join(nodes.select("doc_id").hint("merge"), "doc_id", "left_semi").select("doc_id", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    each = staged(each, "near-shingles")
    common = each.groupBy("shingle").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    ordered = each.join(common, "shingle").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("found"))
    alone = F.col("n") - F.size("found")
    first = F.slice("found", F.lit(1), F.greatest(F.col("n") - F.ceil(F.col("n") * 4 / 5).cast("int") + 1 - alone, F.lit(0)))
    heads = ordered.select("doc_id", F.col("n").cast("long").alias("n"), alone.alias("_alone"), F.posexplode(first).alias("_at", "_of"))
    heads = staged(heads.join(nodes, "doc_id").select("doc_id", "n", "component", "outside", (F.col("n") - F.col("_alone") - F.col("_at")).alias("left"), F.col("_of.shingle").alias("shingle")), "near-heads")
    # 0.8 of the union is 4 / 9 of both sizes together
    x, y = heads.where("outside").alias("x"), heads.alias("y")
    meet = (F.col("x.component") != F.col("y.component")) & _sized("x", "y") & (9 * F.least("x.left", "y.left") >= 4 * (F.col("x.n") + F.col("y.n")))
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & meet)
    return met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def _links(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose full sets meet the threshold."""
    x = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    linked = pairs.join(x, "a").join(y, "b").where(100 * both >= 80 * (F.size("x") + F.size("y") - both))
    return staged(linked.select("a", "b"), "near-links")
