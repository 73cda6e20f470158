import random
import re

import pytest

from tidemark.llm import tokens
from tidemark.llm.tokens import TOKENIZER_FILE, parts, token_sizes, tokenizer

ENCODE, SIZES = tokenizer(TOKENIZER_FILE)


def test_parts_have_the_texts_own_tokens(monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice([" ", "\n", "\t", "  ", "a", "we", "'s", "é", "7", "!?", "мир", "😀", "\r\n"]) for _ in range(20_000))
    whole = ENCODE(text)
    monkeypatch.setattr(tokens, "PART_CHARS", 50)
    cut = list(parts(text))
    assert "".join(x for x, _ in cut) == text and len(cut) > 100
    assert [t for x, _ in cut for t in ENCODE(x)] == whole
    assert SIZES[whole].sum() == len(text.encode())


@pytest.mark.parametrize("text", ["\n" * 1_000_000, " " * 1_000_000, "\n " * 500_000 + "end", "a" * 1_000_000, "x" + "\t" * 700_000 + "x " * 1000])
def test_very_long_runs(text):
    found = ENCODE(text)
    assert SIZES[found].sum() == len(text)


@pytest.mark.parametrize("run", ["\n" * 30, " " * 41, "\n " * 20, "\t" * 25 + "  ", "\u2003" * 22])
@pytest.mark.parametrize("after", ["", "x y", "!", "\x1cz", "7"])
def test_runs_of_blanks_are_one_match(monkeypatch, run, after):
    text = "some words " + run + after + (run + "end " + run if after else "")
    whole = ENCODE(text)
    monkeypatch.setattr(tokens, "PART_CHARS", 5)
    monkeypatch.setattr(tokens, "_BLANKS", re.compile(rf"{tokens._BLANK}{{20,}}"))
    assert any(single for _, single in parts(text))
    assert ENCODE(text) == whole


def test_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "a b", None, 5), (None, None, "x", None), (3, "", "y", 1)], "doc_id bigint, text string, other string, n_tokens int")
    assert sorted(map(tuple, token_sizes(df).collect()), key=str) == sorted([(1, None, 2), (None, "x", 0), (3, "y", 0)], key=str)
    assert token_sizes(df.limit(0)).count() == 0
