"""Language-model scoring with an Elias-Fano n-gram trie.

A bigram model with interpolated absolute discounting: P(w | v) = q(v, w) + b(v) * P(w). The trie is cut into shards by the context's hash. A shard's first level holds its contexts with their counts, numbers of
successors and monotone pointers; the second level holds, in the range that its pointers give, each context's successors relative to the context, with
quantised q. All sequences are Elias-Fano coded flat arrays without Python objects, memory-mapped; each shard's levels are kept in a column of a table on shared files.

Texts are dealt to chunks. A chunk asks each shard once for its distinct bigrams, which carry the chunk's training counts at the same time: the shard first adds up the counts of all
chunks, builds its trie, then answers every chunk by successor search. So each distinct bigram of a chunk is shuffled once, and the answer is two bytes. A chunk has a row for
each shard that it has contexts for: as many as there are shards, and never more than it has contexts.

The most frequent contexts would fill a shard each. They are found first, and each is cut into parts by its successors' hashes; the parts are
contexts of their own, in shards of their own. A chunk asks all parts of such a context that it has, and adds up what they hold.
"""

import itertools
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .elias_fano import EliasFano, mapped, packed
from .near_dedup import mixed

#: Bytes of text in a chunk and tokens asked of a shard, about; both bound a task's memory, and their numbers grow with the input.
CHUNK = 8 << 20
#: Rows in a chunk, about.
ROWS = 100_000
SHARD = 3_000_000
DISCOUNT = 0.75
#: Stand-ins for the hash of the beginning, which is a context only, and of the end, which is a token only.
BEGIN, END = np.uint64(0x5DEECE66D1234567), np.uint64(0xB5026F5AA96619E9)

_U64 = np.uint64
_ASK = "shard int, chunk long, v binary, nv binary, w binary, c binary"
_TELL = "chunk long, shard int, c binary, followers binary, code binary, trie binary, tokens long, words long, texts long, split array<long>"
#: Steps of the quantised logarithms, the same for all shards.
STEPS = 4096


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 when divided by 5. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


class Hot:
    """Frequent contexts in order, the number of parts of each, and the parts' keys, those of one context after another."""

    def __init__(self, words: np.ndarray, parts: np.ndarray):
        self.words, self.parts = words, parts
        self.starts = np.cumsum(parts) - parts
        self.of = np.repeat(np.arange(len(words)), parts)
        self.keys = self.key(words[self.of], np.arange(len(self.of)) - self.starts[self.of])
        self.order = np.argsort(self.keys)

    @staticmethod
    def key(word: np.ndarray, part: np.ndarray) -> np.ndarray:
        return mixed(word + (part.astype(_U64) + _U64(1)) * BEGIN)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each context, and whether it is one of these."""
        if not len(self.words):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return at, self.words[at] == words

    def owner(self, keys: np.ndarray) -> np.ndarray:
        """The number of the context that each key is a part of, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = self.order[np.minimum(np.searchsorted(self.keys, keys, sorter=self.order), len(self.keys) - 1)]
        return np.where(self.keys[at] == keys, self.of[at], -1)


def numbered(texts: Iterable[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The hashes of the distinct words, numbered as they come, and each text's words by their numbers."""
    numbers = defaultdict(itertools.count().__next__)
    split = ((t or "").encode("utf-8", "replace").lower().split() for t in texts)
    parts = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for words in split]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), _U64, len(numbers)), parts


def hot_contexts(rows: DataFrame, shards: int) -> Hot:
    """Contexts that hold more than half a shard's share of all bigrams, about, with a part for each such half. The driver gets 16 * shards rows at most."""
    limit = 4 * shards

    def count(batches):
        held, total = [], 0
        for b in batches:
            names, words = numbered(t.as_py() for t in b.column("text"))
            n = np.bincount(np.concatenate(words) if words else np.empty(0, np.int64), minlength=len(names))
            held.append((np.append(names, BEGIN), np.append(n, len(words))))
            total += int(n.sum()) + len(words)
            if len(held) == 8:
                held = [_added(held)]
        word, n = _added(held) if held else (np.empty(0, _U64), np.empty(0, np.int64))
        much = n * (2 * limit) >= total  # what is dropped is less than half of a word's share that counts
        yield pa.record_batch([pa.array(np.append(word[much].view(np.int64), 0)), pa.array(np.append(n[much], total)), pa.array(np.append(np.ones(much.sum(), bool), False))], names=["word", "n", "real"])

    found = rows.select("text").mapInArrow(count, "word long, n long, real boolean").groupBy("word", "real").agg(F.sum("n").alias("n"))
    total = (found.where("not real").agg(F.sum("n")).first()[0] or 0) if shards > 1 else 0
    if not total:
        return Hot(np.empty(0, _U64), np.empty(0, np.int64))
    table = found.where(F.col("real") & (F.col("n") * (2 * limit) >= total)).toArrow()
    word, n = table["word"].to_numpy().view(_U64), table["n"].to_numpy()
    parts = -(-n * 2 * shards // total)
    order = np.argsort(word)[(parts > 1)[np.argsort(word)]]
    return Hot(word[order], parts[order])


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    word, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
    return word, np.bincount(at, np.concatenate([n for _, n in held]), minlength=len(word)).astype(np.int64)


class Bigrams:
    """The distinct bigrams (context, w) of a chunk in order, and where each token's is. v: the word behind each context, which for parts of a frequent one isn't the context's key."""

    def __init__(self, texts: list[str | None], train: np.ndarray, hot: Hot):
        names, parts = numbered(texts)
        end = len(names)  # the end and the beginning have the numbers behind the words', then come the parts of frequent contexts
        names = np.append(names, [END, BEGIN])
        self.sizes = np.array([len(p) + 1 for p in parts], np.int64)
        ends = np.cumsum(self.sizes)
        token = np.full(int(ends[-1]) if len(ends) else 0, end)
        inner = np.ones(len(token), bool)
        inner[ends - 1] = False
        token[inner] = np.concatenate(parts) if parts else []
        before = np.roll(token, 1)
        before[ends - self.sizes] = end + 1
        key = before.copy()
        owner, frequent = hot.find(names)
        split = frequent[before]
        if split.any():
            at = owner[before[split]]
            key[split] = len(names) + hot.starts[at] + (mixed(names[token[split]]) % hot.parts[at].astype(_U64)).astype(np.int64)
        keys = np.append(names, hot.keys)
        rank = np.empty(len(keys), np.int64)
        rank[np.argsort(keys, kind="stable")] = np.arange(len(keys))
        order = np.argsort(rank[key] * len(keys) + rank[token])  # by the keys' hashes, then the words'
        u, w = keys[key[order]], names[token[order]]
        new = _starts_of(u, w)
        at = np.flatnonzero(new)
        self.of_token = np.empty(len(u), np.int64)
        self.of_token[order] = np.cumsum(new) - 1
        self.w = w[at]
        self.count = np.add.reduceat(np.repeat(train, self.sizes)[order].astype(np.int64), at) if len(at) else np.empty(0, np.int64)
        starts = np.flatnonzero(_starts_of(u[at]))
        context, word, successors = u[at][starts], names[before[order[at[starts]]]], np.diff(np.append(starts, len(at)))
        # all parts of a frequent context are asked for, also those without a successor here
        mine = np.unique(hot.find(word)[0][hot.find(word)[1]])
        if len(mine):
            every = np.isin(hot.of, mine)
            keys, owners = hot.keys[every], hot.words[hot.of[every]]
            more = ~np.isin(keys, context)
            context, word, successors = np.append(context, keys[more]), np.append(word, owners[more]), np.append(successors, np.zeros(more.sum(), np.int64))
        order = np.argsort(context, kind="stable")
        self.context, self.v, self.nv = context[order], word[order], successors[order]

    def cuts(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Each context's shard, which rises with its key."""
        shard = ((self.context >> _U64(32)) * _U64(shards) >> _U64(32)).astype(np.int64)
        return np.unique(shard, return_index=True)


def _starts_of(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def squeezed(values: np.ndarray) -> bytes:
    """Small counts and codes compressed, all lowest bytes first, then all second ones, and so on."""
    return zstandard.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def spread(data: bytes, kind: type) -> np.ndarray:
    """The values of squeezed()."""
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def coded(power: np.ndarray) -> np.ndarray:
    """Codes of log10 probabilities, from 1 on, 1 / STEPS apart; 0 is left for what isn't there."""
    return (1 + np.minimum(np.rint(-power * STEPS), 65534)).astype(np.uint16)


def decoded(code: np.ndarray) -> np.ndarray:
    """The probabilities."""
    return np.where(code > 0, 10.0 ** ((1 - code.astype(np.float64)) / STEPS), 0.0)


class TrieShard:
    """Two levels of the trie for a range of contexts. v, w and count: distinct bigrams in order, with their training counts."""

    def __init__(self, v: np.ndarray, w: np.ndarray, count: np.ndarray):
        known = count > 0
        v, w, count = v[known], w[known], count[known]
        starts = np.flatnonzero(_starts_of(v))
        self.n = len(starts)
        total = np.add.reduceat(count, starts) if self.n else np.empty(0, np.int64)
        followers = np.diff(np.append(starts, len(v)))
        context = np.repeat(np.arange(self.n), followers)
        words = np.unique(w)
        self.width = len(words) + 1
        self.contexts = EliasFano(v[starts], 1 << 64)
        self.pointers = EliasFano(np.append(starts, len(v)).astype(_U64), len(v) + 1)
        self.children = EliasFano((context * self.width + np.searchsorted(words, w)).astype(_U64), max(1, self.n * self.width))
        code = coded(np.log10((count - DISCOUNT) / total[context]) if len(v) else np.empty(0))
        levels = (self.contexts, self.pointers, self.children)
        self.data = packed([total.astype(np.int64), words, code, *(x for e in levels for x in (e.low, e.high))])
        arrays = mapped(self.data)
        self.count, self.words, self.code = arrays[:3]
        for e, low, high in zip(levels, arrays[3::2], arrays[4::2], strict=True):
            e.low, e.high = low, high

    def context(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each context, and whether it is there."""
        at, found = self.contexts.successor(v)
        return np.where(found, at, 0), found

    def followers(self, context: np.ndarray) -> np.ndarray:
        return (self.pointers.access(context + 1) - self.pointers.access(context)).astype(np.int64)

    def child(self, context: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The code of each successor in its context's range, 0 if it isn't there."""
        relative = np.searchsorted(self.words, w)
        here = np.minimum(relative, len(self.words) - 1)
        at, found = self.children.successor((context * self.width + relative).astype(_U64))
        found &= self.words[here] == w
        return np.where(found, self.code[np.where(found, at, 0)], 0).astype(np.uint16)


def _answers(hot: Hot):
    def run(key, table):
        get = lambda name, kind, read: [read(x, kind) for x in table[name].to_pylist()]
        vs, nvs, ws, cs = get("v", _U64, np.frombuffer), get("nv", np.uint32, spread), get("w", _U64, np.frombuffer), get("c", np.uint32, spread)
        v, nv, w = np.concatenate(vs), np.concatenate(nvs), np.concatenate(ws)
        each = np.repeat(v, nv)
        order = np.lexsort((w, each))
        sv, sw = each[order], w[order]
        at = np.flatnonzero(_starts_of(sv, sw))
        trie = TrieShard(sv[at], sw[at], np.add.reduceat(np.concatenate(cs).astype(np.int64)[order], at) if len(at) else np.empty(0, np.int64))
        own = np.unique(sv[at])
        own = own[trie.context(own)[1]] if trie.n else own[:0]
        owner = hot.owner(own)
        begins = (own == BEGIN) | (owner >= 0) & (hot.words[owner] == BEGIN) if len(hot.words) else own == BEGIN
        split = np.unique(owner[(owner >= 0) & ~begins]).tolist()
        del order, sv, sw, at, each
        out = [(-1, key[0].as_py(), None, None, None, trie.data, int(trie.count[~begins].sum()), int((~begins & (owner < 0)).sum()), int(trie.count[begins].sum()), split)]
        for chunk, v, nv, w in zip(table["chunk"].to_pylist(), vs, nvs, ws, strict=True):
            if trie.n:
                context, found = trie.context(v)
                count, followers = np.where(found, trie.count[context], 0), np.where(found, trie.followers(context), 0)
                code = trie.child(np.repeat(context, nv), w)
                code[~np.repeat(found, nv)] = 0
            else:
                count, followers, code = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), np.zeros(len(w), np.uint16)
            out.append((chunk, key[0].as_py(), squeezed(count.astype(np.int64)), squeezed(followers.astype(np.uint32)), squeezed(code), None, None, None, None, None))
        kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split(" ")[0] for x in _TELL.split(", ")])

    return run


def lm_score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs; the model learns from the rows that aren't held out.

    Words are runs without ASCII white space after lower-casing A-Z, and each text has one end besides. base_score is the sum of log10((c + 0.5) / (N + 0.5 * (V + 1))) over the tokens, score the model's log10 probability of the
    text. A null or empty text is its end only. Repeated rows count as often as they come; a null id counts as the empty text when rows are held out. Without training rows both scores
    follow from counts of 0; empty tables give no rows. Other columns are not read.
    """
    size, n = (x or 0 for x in docs.agg(F.sum(F.octet_length("text")), F.count("*")).first())
    chunks, shards = max(size // CHUNK, n // ROWS) + 1, size // (6 * SHARD) + 1
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk")
    rows = docs.select("doc_id", "text", (~held_out(F.col("doc_id"))).alias("train"), chunk)
    hot = hot_contexts(rows, shards)

    def ask(key, table):
        found = Bigrams(table["text"].to_pylist(), table["train"].to_numpy(), hot)
        shard, starts = found.cuts(shards)
        stops = np.append(starts[1:], len(found.v))
        ends = np.concatenate([[0], np.cumsum(found.nv)])
        out = []
        for s, a, b in zip(shard, starts, stops, strict=True):
            part = slice(ends[a], ends[b])
            out.append((int(s), key[0].as_py(), found.context[a:b].tobytes(), squeezed(found.nv[a:b].astype(np.uint32)), found.w[part].tobytes(), squeezed(found.count[part].astype(np.uint32))))
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
        return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=[x.split(" ")[0] for x in _ASK.split(", ")])

    asked = rows.groupBy("chunk").applyInArrow(ask, _ASK)
    told = staged(asked.groupBy("shard").applyInArrow(_answers(hot), _TELL), "lm-answers", {"compression": "zstd"})
    level = told.where("chunk < 0")
    inner, words, texts = (x or 0 for x in level.agg(F.sum("tokens"), F.sum("words"), F.sum("texts")).first())
    split = level.select(F.explode("split")).distinct().count()
    total, distinct = inner + texts, words + split + (texts > 0)

    def score(key, table, answer):
        found = Bigrams(table["text"].to_pylist(), table["train"].to_numpy(), hot)
        answer = answer.sort_by("shard").to_pylist()
        get = lambda name, kind: np.concatenate([spread(a[name], kind) for a in answer])
        own = get("c", np.int64)
        direct = decoded(get("code", np.uint16))
        word, of = np.unique(found.v, return_inverse=True)
        count = np.bincount(of, own, minlength=len(word)).astype(np.int64)
        followers = np.bincount(of, get("followers", np.uint32), minlength=len(word))
        back = np.where(count > 0, DISCOUNT * followers / np.maximum(1, count), 1.0)
        share = own / np.maximum(1, count[of])  # of a part in its context; else 1
        at = np.minimum(np.searchsorted(word, found.w), len(word) - 1)
        known = np.where(found.w == END, texts, np.where(word[at] == found.w, count[at], 0))
        single = (known + 0.5) / (total + 0.5 * (distinct + 1))
        model = np.log10(direct * np.repeat(share, found.nv) + np.repeat(back[of], found.nv) * single)
        starts = np.cumsum(found.sizes) - found.sizes
        add = lambda x: np.add.reduceat(x[found.of_token], starts)
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        data = (table["doc_id"].cast(pa.int64()), pa.array(~table["train"].to_numpy()), pa.array(found.sizes), pa.array(add((known > 0).astype(np.int64))), pa.array(np.full(len(starts), total, np.int64)), pa.array(add(np.log10(single))), pa.array(add(model)))
        return pa.table(data, names=names)

    answers = told.where("chunk >= 0").select("chunk", "shard", "c", "followers", "code")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
