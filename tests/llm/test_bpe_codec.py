import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import bpe_codec
from quern.llm.bpe_codec import Codec, decode, encode, load, merge_all, merge_beside

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


def ids(codec, text):
    return np.frombuffer(codec.encode(text), dtype="<i4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["the", " the", "  ", "\n", " \n", "\n ", "é", "Ünter", "'s", "'LL", "123", "!?", "<|endoftext|>", " ", "\t", "日本", "\U0001f600", "a" * 40, "zq"]), max_size=25).map("".join) | st.text(max_size=60))
def test_same_as_library(text):
    codec = load(PATH)
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(codec, text) == want
    assert codec.decode(want) == LIBRARY.decode(want, skip_special_tokens=False) == text


def test_long_words():
    codec, rng = Codec(PATH), random.Random(3)
    for text in ("a" * 5000, " " * 3000, "".join(rng.choice("abcdeé ") for _ in range(20000)), "".join(rng.choice("thean") for _ in range(30000))):
        assert ids(codec, text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_trees_beside_one_another():
    codec, rng = Codec(PATH), random.Random(4)
    words = ["".join(rng.choice("theanorisé1") for _ in range(rng.randrange(1, 60))).encode()[:64] for _ in range(3000)]
    got = merge_beside(words, codec.byte_array, codec.pairs)
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == [merge_all([codec.byte_ids[b] for b in w], codec.ranks) for w in words]


def test_broken_bytes_are_replaced():
    got = LIBRARY.encode("é日", add_special_tokens=False).ids
    for cut in range(len(got)):
        assert load(PATH).decode(got[cut:]) == LIBRARY.decode(got[cut:], skip_special_tokens=False)


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "k"), (None, "", "k"), (2, "Hello  there", "k"), (2, "Hello  there", "k")], "doc_id long, text string, ids string")
    out = decode(encode(docs, PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted(((r.doc_id or 0), len(r.ids), r.decoded) for r in out.collect()) == [(0, 0, ""), (1, 0, ""), (2, 3, "Hello  there"), (2, 3, "Hello  there")]
    assert decode(encode(docs.limit(0), PATH), PATH).count() == 0


def test_many_texts_at_once_and_a_small_memory(monkeypatch):
    """Texts of all kinds beside one another, again and again, with few words remembered."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    made = []
    for i in range(300):
        parts = [rng.choice(words) + rng.choice(["", "", ".", ",", "'s", "!?", "7", "\n", "\t"]) for _ in range(rng.randrange(0, 120))]
        made.append(rng.choice([" ", " ", "  "]).join(parts) + rng.choice(["", " ", "<|endoftext|>"]))
    made += ["", " ", ".", " .", "a", " a", "a.", "x" * 70_000 + " y", "word " * 30_000]
    monkeypatch.setattr(bpe_codec, "REMEMBERED_BYTES", 200_000)
    codec = bpe_codec.Codec(PATH)
    for _ in range(2):
        flat, ends = codec.encode_all(made)
        got = [x.tolist() for x in np.split(flat, ends[:-1])]
        assert got == [LIBRARY.encode(x, add_special_tokens=False).ids for x in made]
        assert codec.decode_all(flat, ends) == made
    assert codec.decode([10**6, -3, 64]) == codec.decode([64])
