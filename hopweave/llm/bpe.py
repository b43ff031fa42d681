"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs, and decoding.

A text is cut at special tokens, normalised and split into pieces; each distinct piece of a partition is encoded once. The leaves of a
piece's tree hold the merge ranks of its adjacent pairs, so the root is the leftmost pair of the lowest rank. A merge updates
three leaves, each in logarithmic time, until the root says that no pair can be merged. Short pieces are worked on together, one
tree a row of an array; long ones have a tree each.
"""

import hashlib
import json
import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Cached pieces before a task starts a new cache.
CACHE = 400_000
#: Longer pieces have a tree of their own.
TOGETHER = 64
NONE = np.int64(1) << 40

#: The white space of Unicode.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = regex.compile(f"[{WHITE}]+")


def _ranges(text: str) -> list[tuple[int, int]]:
    return [(int(x, 16), int(y or x, 16)) for x, _, y in (r.partition("-") for r in text.split())]


#: Code points that are letters, or numbers, since Unicode 16, the version of the library's classes; unicodedata here is of 15.1.
LETTERS_16 = _ranges(
    "1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7 113d1 113d3 "
    "11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0"
)
NUMBERS_16 = _ranges("10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa")
#: Fixed values: (first, last, offset) of the letters whose small form came after 15.1.
LOWER_SINCE = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))
#: Combining marks since Unicode 9, the version of the library's normal forms, for which they are no marks.
MARKS_SINCE = _ranges(
    "7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85 11070 1133b 1145e 11839-1183a 11930 "
    "1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef"
)
_inside = lambda ranges: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
NO_MARK = regex.compile(f"([{_inside(MARKS_SINCE)}])")
NEW_CAPITAL = regex.compile(f"[{_inside((a, b) for a, b, _ in LOWER_SINCE)}]")
NEW_SMALL = {c: c + by for a, b, by in LOWER_SINCE for c in range(a, b + 1)}


def unicode_class(kind: str, more: list[tuple[int, int]]) -> str:
    """The inside of a character class with all code points whose category begins with kind, and more."""
    has = np.array([unicodedata.category(chr(c))[0] == kind for c in range(sys.maxunicode + 1)])
    edges = np.flatnonzero(np.diff(has, prepend=False, append=False)).reshape(-1, 2)
    return _inside([*((a, b - 1) for a, b in edges.tolist()), *more])


def normal(text: str) -> str:
    """The composed form with white space as one space and small letters."""
    if NO_MARK.search(text):
        text = "".join([p if i % 2 else unicodedata.normalize("NFC", p) for i, p in enumerate(NO_MARK.split(text))])
    else:
        text = unicodedata.normalize("NFC", text)
    text = SPACE.sub(" ", text).replace("Σ", "σ").lower()
    return text.translate(NEW_SMALL) if NEW_CAPITAL.search(text) else text


def load(path: str) -> dict:
    """The parts of a tokenizer file of this kind that encoding needs. Its size doesn't depend on the data."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab = file["model"]["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
    split = file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    return {"vocab": vocab, "pairs": pairs, "suffix": file["model"]["end_of_word_suffix"], "special": {t["content"]: t["id"] for t in file["added_tokens"]}, "pattern": split}


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["suffix"]
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in model["special"].items()}
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end] for c in letters], np.int64)
        left, right = (np.array([vocab[p[k]] for p in model["pairs"]], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in model["pairs"]], np.int64)
        key = left << 20 | right
        order = np.argsort(key)
        self.keys, self.ranks, self.made = key[order], order, made[order]
        self.by_pair = {int(k): (int(r), int(m)) for k, r, m in zip(self.keys, self.ranks, self.made, strict=True)}
        self.by_rank = made
        self.special = model["special"]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.source = model["pattern"].replace(r"\s", WHITE)
        self.pattern = regex.compile(self.source)
        self.usual = set(map(chr, range(128)))  # characters met so far that regex and unicodedata treat as the library does
        self.ids: dict[str, str] = {}
        self.text: dict[str, str] = {}
        self.n: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        """Pieces in order. Special tokens come with a leading NUL, which no piece of another kind starts with after it was split."""
        if self.cut is None or not self.cut.search(text):
            return self._split(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self._split(text[at : m.start()]), "\0special" + m[0]]
            at = m.end()
        return out + self._split(text[at:])

    def _split(self, text: str) -> list[str]:
        if not text.isascii() and not self.usual.issuperset(text):
            new = set(text) - self.usual
            odd = {c for c in new if unicodedata.category(c) == "Cn" or NO_MARK.match(c) or NEW_CAPITAL.match(c)}
            self.usual |= new - odd
            if odd:
                return self.exact().findall(normal(text))
        return self.pattern.findall(SPACE.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower())

    @cache  # noqa: B019  one encoder a task
    def exact(self) -> regex.Pattern:
        """The pattern with its classes written out, which is slower."""
        return regex.compile(self.source.replace(r"\p{L}", unicode_class("L", LETTERS_16)).replace(r"\p{N}", unicode_class("N", NUMBERS_16)))

    def learn(self, pieces: set[str]) -> None:
        """Encodes the pieces that are not yet in the cache."""
        if len(self.ids) > CACHE:
            self.ids, self.text, self.n = {}, {}, {}
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            if p not in self.ids:
                if p.startswith("\0special"):
                    self._keep(p, [self.special[p[8:]]])
                    continue
                raw = p.encode("utf-8", "replace")
                if len(raw) > TOGETHER:
                    self._keep(p, self.encode_long(raw))
                else:
                    by_size.setdefault(1 << max(0, len(raw) - 1).bit_length(), []).append((p, raw))
        for width, words in by_size.items():
            for i in range(0, len(words), 20_000):
                part = words[i : i + 20_000]
                for (p, _), ids in zip(part, self.encode_together([raw for _, raw in part], width), strict=True):
                    self._keep(p, ids)

    def _keep(self, piece: str, ids: list[int]) -> None:
        self.ids[piece] = " ".join(map(str, ids))
        self.text[piece] = " ".join([self.token[i] for i in ids])
        self.n[piece] = len(ids)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_together(self, words: list[bytes], width: int) -> list[list[int]]:
        """Ids of words of at most width bytes; width is a power of two. Leaf i of a tree is the pair that starts at symbol i."""
        n, sizes = len(words), np.array([len(w) for w in words])
        cells = np.zeros((n, width), np.uint8)
        cells[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[cells]
        rows = np.arange(n)
        symbols[rows, sizes - 1] = self.final[cells[rows, sizes - 1]]
        if width == 1:
            return [[int(s)] for s in symbols[:, 0]]
        place = np.arange(width)
        alive = place < sizes[:, None]
        after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * width), NONE)
        pairs = alive[:, 1:]
        ranks = np.full((n, width), NONE)
        ranks[:, :-1][pairs] = self._rank(symbols[:, :-1][pairs], symbols[:, 1:][pairs])
        tree[:, width:] = np.where(ranks < NONE, ranks * width + place, NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def update(r, at, value):
            node = at + width
            tree[r, node] = value
            while (node := node >> 1)[0]:
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        def put(r, at, other):
            rank = self._rank(symbols[r, at], symbols[r, other])
            update(r, at, np.where(rank < NONE, rank * width + at, NONE))

        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            best = tree[live, 1]
            at = best % width
            gone = after[live, at]
            symbols[live, at] = self.by_rank[best // width]
            alive[live, gone] = False
            far = after[live, gone]
            after[live, at] = far
            update(live, gone, NONE)
            follows = far < sizes[live]
            if follows.any():
                r, a, b = live[follows], at[follows], far[follows]
                before[r, b] = a
                put(r, a, b)
            if not follows.all():
                update(live[~follows], at[~follows], NONE)
            leads = before[live, at] >= 0
            if leads.any():
                r, a = live[leads], at[leads]
                put(r, before[r, a], a)
            live = live[tree[live, 1] < NONE]
        return [s[a].tolist() for s, a in zip(symbols, alive, strict=True)]

    def encode_long(self, word: bytes) -> list[int]:
        """The same for one word of any length."""
        symbols = [int(self.inner[b]) for b in word[:-1]] + [int(self.final[word[-1]])]
        n = len(symbols)
        width = 1 << (n - 1).bit_length()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [int(NONE)] * (2 * width)
        pairs, none = self.by_pair, (int(NONE), 0)

        def leaf(i):
            rank = pairs.get(symbols[i] << 20 | symbols[after[i]], none)[0] if after[i] < n else int(NONE)
            return rank * width + i if rank < NONE else int(NONE)

        def update(i, value):
            node = i + width
            tree[node] = value
            while node := node >> 1:
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        for i in range(n):
            tree[width + i] = leaf(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < NONE:
            i = tree[1] % width
            gone = after[i]
            symbols[i] = int(self.by_rank[tree[1] // width])
            symbols[gone] = None
            after[i] = after[gone]
            update(gone, int(NONE))
            if after[i] < n:
                before[after[i]] = i
            update(i, leaf(i))
            if before[i] >= 0:
                update(before[i], leaf(before[i]))
        return [s for s in symbols if s is not None]

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces(text)
        self.learn(set(pieces))
        return [int(i) for p in pieces if self.ids[p] for i in self.ids[p].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by one space, as these files have no decoder."""
        return " ".join([self.token[i] for i in ids])


def bpe_encode(docs: DataFrame, tokenizer_path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (as text, decimal, one space between; null unless keep_ids), decoded, and sha256 of both.

    A null text counts as empty and gives no ids. Every row gives a row, repeated ones too; a null doc_id is carried on. Empty tables
    give no rows. Texts of any length are encoded whole. Other columns are not read. Nothing is shuffled. All code points are
    classed, composed and lower-cased as the file's own library does.
    """
    model = docs.sparkSession.sparkContext.broadcast(load(tokenizer_path))
    names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())

    def run(batches):
        encoder = Encoder(model.value)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            start = 0
            while start < len(ids):
                pieces, size, end = [], 0, start
                while end < len(ids) and size < 1 << 21:
                    text = texts[end].as_py() or ""
                    size += len(text)
                    pieces.append(encoder.pieces(text))
                    end += 1
                encoder.learn(set().union(*pieces))
                out = []
                for doc, own in zip(ids[start:end], pieces, strict=True):
                    listed = " ".join([encoder.ids[p] for p in own])
                    decoded = " ".join([encoder.text[p] for p in own])
                    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, decoded)]
                    out.append((doc, sum([encoder.n[p] for p in own]), *digests, *((listed, decoded) if keep_ids else (None, None))))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                start = end

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids string, decoded string")
