"""Token counts against the plain library on whole texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from phasegrid.llm import token_counts
from phasegrid.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(token_counts.tokenizer_path())
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


BITS = ["a", "don't", "we'll", "'s", "''", " ", "  ", "\n", "\n\n", " \n", "\t", "\x1c", "\x85", " ", "　", "é", "Straße", "12", "3.5", "中文", "。", "😀", "<|endoftext|>", "<|endof", "text|>", "x" * 30, "the.\nThe", "one,two", "!?", "́", "\r\n", "Ñ", "\x00", "١٢"]


def some_text(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(BITS) for _ in range(n))


def test_query_equals_library(spark, plain):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in token_counts.op11_token_counts(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        n = plain(r.text)
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_bytes, g.over_limit) == (n, len((r.text or "").encode()), n > 1024)


@pytest.mark.parametrize("seed", range(3))
def test_words_and_splices_equal_library(plain, seed):
    rng = random.Random(seed)
    known = token_counts._Counts(token_counts.tokenizer_path())
    texts = [some_text(rng, rng.choice([0, 1, 3, 10, 60])) for _ in range(400)]
    assert known.count(texts) == [plain(t) for t in texts]
    for _ in range(150):
        t = some_text(rng, rng.choice([20, 80, 200]))
        assert token_counts.spliced(t, known.starts, rng.choice([5, 16, 64]), rng.choice([1, 4, 16]), known.special)[0] == plain(t)


def test_overlaps_widen_until_both_chunks_agree(plain):
    known = token_counts._Counts(token_counts.tokenizer_path())
    n, encoded = token_counts.spliced("word " * 400, known.starts, 256, 32)
    assert n == plain("word " * 400) and encoded == 8
    t = "ab " * 50 + "x" * 300 + " cd" * 50  # no place to cut within the first overlaps
    n, encoded = token_counts.spliced(t, known.starts, 300, 16)
    assert n == plain(t) and encoded == 2  # the overlap widened to 256 before anything was encoded
    t = "é" * 2000  # nowhere: the whole text is one chunk in the end
    assert token_counts.spliced(t, known.starts, 64, 8)[0] == plain(t)


def test_odd_rows(spark, plain):
    long = " ".join(f"wörd{i} x{i % 7}." for i in range(90_000))
    rows = [(1, None), (2, ""), (3, " "), (3, " "), (None, "a b"), (4, "x" * 5000), (5, "y" * 200_000), (6, long), (7, "<|endoftext|> a <|endoftext|>")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, n_bytes string, n_tokens int")
    got = sorted(map(tuple, token_counts.count_tokens(df).select("doc_id", "n_bytes", "n_tokens").collect()), key=str)
    assert got == sorted([(i, len((t or "").encode()), plain(t)) for i, t in rows], key=str)
    assert {r.doc_id for r in token_counts.count_tokens(df).filter("n_chunks > 1").collect()} == {5, 6}
    assert token_counts.count_tokens(df.filter(F.lit(False))).count() == 0


def test_starts_are_characters():
    known = token_counts._Counts(token_counts.tokenizer_path())
    assert np.array_equal(known.starts("ab cd"), [0, 2])
