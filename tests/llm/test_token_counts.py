import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm.token_counts import Segmented, count_tokens, load, token_counts

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda x: len(t.encode(x, add_special_tokens=False))


def odd_texts():
    rng = random.Random(5)
    parts = ["the", "Über", "don't", "x" * 90, " ", "  ", "\n", "\t", "́", "á", " ", "<|endoftext|>", "<|startoftext|>", "12345", "!!", "\x1c", "\x1f!", " ", "\U0001f600", "ſ", "İ", "Ω", "日本", "가"]
    return ["", " ", "\n\n", *("".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(1, 120))) for _ in range(150))]


@pytest.mark.parametrize("path", [WORD, BYTE])
@pytest.mark.parametrize("chunk,overlap", [(40, 8), (64, 4), (200, 32), (10**6, 10)])
def test_same_as_library(path, chunk, overlap):
    want, encoder = library(path), Segmented(path)
    assert encoder.rule
    for text in odd_texts():
        assert count_tokens(encoder, text, chunk, overlap)[0] == want(text), text


def test_overlap_is_widened_without_white_space():
    encoder, text = Segmented(WORD), "ab" * 3000 + " tail of the text " * 30
    got, chunks, widened = count_tokens(encoder, text, 256, 16)
    assert got == library(WORD)(text) and widened > 0 and chunks > 1


def test_model_file():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    want = sentencepiece.SentencePieceProcessor(model_file=path)
    for text in ("", "Hello  world", "über " * 40):
        assert count_tokens(load(path), text, 30, 5)[0] == len(want.encode(text))


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a b", "y"), (2, "", "z"), (2, "", "z"), (3, "word " * 5000, "w")], "doc_id long, text string, n_tokens string")
    rows = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, WORD).collect()}
    assert rows == {(1, 0, 0, False), (None, 3, 2, False), (2, 0, 0, False), (3, 25000, 5000, True)}
    assert token_counts(docs.limit(0), WORD).count() == 0
