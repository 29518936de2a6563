import random

import pytest

from lodestone.llm.tokenize import FragmentEncoder, count_tokens, encode_corpus, vocabulary_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    whole = tokenizers.Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    return lambda text: whole.encode(text, add_special_tokens=False).ids


CASES = ["", " ", "  a", "\n\n中文", "a　b  c", "<|endoftext|> x", "don't 'sé we're —'s", "x" * 3000, " \n \n x", "1st 2nd3rd", "👍🏽👍 🧪‍🔬", "\x1c\x1da\x85\x85b", "ﬀ é é"]


@pytest.mark.parametrize("text", CASES)
def test_same_ids(text, reference):
    assert FragmentEncoder(vocabulary_path()).encode(text) == reference(text)


def test_same_ids_on_random_texts(reference):
    draw, coder = random.Random(5), FragmentEncoder(vocabulary_path())
    for _ in range(3000):
        text = "".join(draw.choice("ab'sre \n\t　 é中1٣.!—’  Ω<|>") for _ in range(draw.randint(1, 30)))
        assert coder.encode(text) == reference(text), repr(text)


def test_rows(spark, reference):
    rows = [(1, "Hello world", 0), (2, None, 0), (3, "", 0), (1, "Hello world", 1), (None, "中 文", 0)]
    df = spark.createDataFrame(rows, "k bigint, t string, ids int")
    found = [(r.k, r.ids) for r in encode_corpus(df, "k", "t").collect()]
    assert sorted(found, key=str) == sorted([(k, reference(t) if t else []) for k, t, _ in rows], key=str)
    assert {r.k: r.n_tokens for r in count_tokens(df, "k", "t").collect()}[2] == 0
    assert encode_corpus(df.limit(0), "k", "t").count() == 0
