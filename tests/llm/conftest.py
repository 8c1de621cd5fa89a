"""Documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import public_tokenizers
import pytest

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, id long, t string, score double, n long, kept boolean"
TEXTS = [
    None,
    "",
    " \n\t",
    "one",
    "One  two",
    "The quick brown fox jumps over the lazy dog. " * 12,
    "The quick brown fox jumps over the lazy dog. " * 12,
    "x" * 40_000,
    "word " * 30_000,
    "ünï ñöñ ß ſ İ Σίσυφος 中文 🙂 é",
    "a\x0bb\x0cc\x1cd e\r\n",
    "<|endoftext|> I'll 's 're ''s 12 ½ ٣",
    "mail a@b.example.com or +1 (663) 555-6869, 10.0.0.1, 4111 1111 1111 1111",
]


def rows():
    out = [(k, t, "en" if k % 2 else None, -k, "clash", 0.5, 7, False) for k, t in enumerate(TEXTS)]
    return [*out, out[5], out[5], (None, TEXTS[5], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
