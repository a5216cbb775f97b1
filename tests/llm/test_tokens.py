import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm.tokens import SAME, TokenCounter, count_tokens, load, prove_whole, tokenizer_path


@pytest.fixture(scope="module")
def counter():
    path = tokenizer_path()
    return TokenCounter(path, prove_whole(path))


def direct(tok, text):
    return len(tok.encode(text or "", add_special_tokens=False).ids)


def test_both_engines_cut_alike_in_the_listed_ranges():
    tok, pattern = load(tokenizer_path())
    for a, b in SAME:
        for c in range(a, b + 1):
            s = f"a{chr(c)}1{chr(c)}-{chr(c)} {chr(c)} \n{chr(c)}"
            assert [s[i:j] for _, (i, j) in tok.pre_tokenizer.pre_tokenize_str(s)] == pattern.findall(s), hex(c)


def test_counts_equal_the_library(counter):
    tok = Tokenizer.from_file(tokenizer_path())
    rnd = random.Random(6)
    pieces = ["the", " the", "'s", "  ", "\n\n", "\t", "é", "ciónmente", "Haus ", "漢字", "🙂", "࢈", "123", "½", "\x00",
              "<|endoftext|>", "<|endof", "don't", "İ", " ", "\xa0", "ﬁ", "a" * 50, "_-_", "́", "\x1c", "\x85", "ǆ"]
    for _ in range(1500):
        s = "".join(rnd.choice(pieces) + rnd.choice(["", " ", "x"]) for _ in range(rnd.randrange(30)))
        assert counter.count(s) == direct(tok, s), repr(s)
    for s in (None, "", " ", "z" * 30000, "ab " * 20000, "<|endoftext|>" * 3):
        assert counter.count(s) == direct(tok, s)


def test_query_rows(spark, frame):
    tok = Tokenizer.from_file(tokenizer_path())
    rows = [(1, "hello world"), (1, "hello world"), (None, "x" * 3000 + " y" * 600), (3, None), (4, ""), (5, "naïve 漢字 🙂")]
    df = frame(rows).withColumn("n_tokens", F.lit("clash")).withColumn("count", F.lit(1))
    got = sorted((tuple(r) for r in count_tokens(df).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), direct(tok, t), direct(tok, t) > 512) for i, t in rows), key=str)
    assert got == want
    assert count_tokens(df.where("false")).count() == 0
