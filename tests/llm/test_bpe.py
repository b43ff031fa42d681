import hashlib
import random
import sys
import unicodedata

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hopweave.llm import bpe
from hopweave.llm.bpe import Encoder, bpe_encode, byte_letters, load

from .helpers import SCHEMA, rows, table, tuples

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    return Encoder(load(PATH))


def test_like_the_library(spark, library):
    data = rows()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = []
    for r in data:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        wanted.append((r[0], len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    found = tuples(bpe_encode(table(spark, data), PATH), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    key = lambda r: tuple(map(str, r))
    assert sorted(found, key=key) == sorted(wanted, key=key)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60))
def test_any_text(library, encoder, text):
    assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert encoder.decode(encoder.encode(text)) == library.decode(library.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


def test_code_points_of_all_kinds(library, encoder):
    """Both ends of every run of one category and of the fixed ranges, and every 61st of all."""
    letters = byte_letters()
    kinds = [unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1)]
    ends = {c + k for a, b, *_ in (*bpe.LETTERS_16, *bpe.NUMBERS_16, *bpe.MARKS_SINCE, *bpe.LOWER_SINCE) for c in (a, b) for k in (-1, 0, 1)}
    points = [chr(c) for c in range(sys.maxunicode) if not 0xD800 <= c < 0xE000 and (c % 61 == 0 or c in ends or kinds[c] != kinds[c - 1] or kinds[c] != kinds[c + 1])]
    for i in range(0, len(points), 512):
        for shape in ("a{0}b1{0} e{0}\u0323\u0301", "\u00e1{0}\u0323 {0}"):
            text = " ".join(shape.format(c) for c in points[i : i + 512])
            wanted = [p for p, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
            assert ["".join([letters[b] for b in p.encode()]) for p in encoder._split(text)] == wanted


def test_words_of_all_lengths(library, encoder):
    rng = random.Random(1)
    for n in [*range(1, 70), 127, 128, 129, 1000, 20_000]:
        word = "".join(rng.choice("etaoinshrdluéß한") for _ in range(n))
        assert encoder.encode(word) == library.encode(word, add_special_tokens=False).ids
        repeated = "a" * n
        assert encoder.encode(repeated) == library.encode(repeated, add_special_tokens=False).ids


def test_long_and_short_trees_agree(encoder):
    rng = random.Random(2)
    for _ in range(300):
        raw = "".join(rng.choice("thequickbrown") for _ in range(rng.randint(1, 60))).encode()
        assert encoder.encode_together([raw], 1 << max(0, len(raw) - 1).bit_length())[0] == encoder.encode_long(raw)


def test_empty(spark):
    assert bpe_encode(spark.createDataFrame([], SCHEMA), PATH).collect() == []
