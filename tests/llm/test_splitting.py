import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import splitting
from tidemark.llm.tokens import TOKENIZER_FILE, tokenizer

ENCODE = tokenizer(TOKENIZER_FILE)[0]


def cues(rng, n, br="\n"):
    words = ["Halt!", "été", "мост", "we said no.", "😀 ok", "…", "now", "「橋」", "it's"]
    return "".join(f"{i}{br}00:00:{i % 60:02d},000 --> 00:00:{i % 60:02d},900{br}{' '.join(rng.choice(words) for _ in range(rng.randint(1, 14)))}{br}{br}" for i in range(n))


def check(text, rows, limit, overlap):
    rows = sorted(rows, key=lambda r: r.piece_no)
    assert [r.piece_no for r in rows] == list(range(len(rows)))
    assert rows[0].start == 0 and rows[-1].end == len(text)
    back = ""
    for before, r in zip([None, *rows], rows):
        assert r.piece == text[r.start : r.end] and len(ENCODE(r.piece)) == r.n_tokens < limit
        if before:
            assert before.start < r.start < before.end < r.end
            shared = text[r.start : before.end]
            assert abs(len(ENCODE(shared)) - overlap) <= 3
        back += text[(before.end if before else 0) : r.end]
    assert back == text


@pytest.mark.parametrize(("limit", "overlap", "range_chars"), [(2000, 100, 65_536), (300, 20, 5000), (200, 100, 701)])
def test_pieces_give_the_text_back(spark, limit, overlap, range_chars):
    rng = random.Random(limit)
    texts = {1: cues(rng, 300), 2: cues(rng, 400, "\r\n"), 3: "word " * 4000, 4: "я" * 9000, 5: "One sentence of words. " * 900, 6: "line of text\n" * 1500, 7: "short", 8: "", 9: None, 10: "-" * 30_000, 11: "\n" * 9000, 12: "😀" * 3000}
    df = spark.createDataFrame([(i, x, "clash", 0) for i, x in texts.items()], "doc_id bigint, text string, part string, start int")
    rows = splitting.split_texts(df, limit, overlap, range_chars).collect()
    large = {i for i, x in texts.items() if x and len(ENCODE(x)) > limit + 20}
    assert large <= {r.doc_id for r in rows} <= {i for i, x in texts.items() if x and len(ENCODE(x)) > limit - 20}
    for i in large:
        check(texts[i], [r for r in rows if r.doc_id == i], limit, overlap)
    for r in rows:
        if r.ends_at == "cue":
            assert r.piece.endswith(("\n\n", "\r\n\r\n"))
        elif r.ends_at == "line":
            assert r.piece.endswith("\n")
    if limit < 300:  # a cue may not fit between the overlap and the limit
        return
    kinds = {i: {r.ends_at for r in rows if r.doc_id == i} - {"end"} for i in large}
    assert kinds[1] == kinds[2] == {"cue"} and kinds[5] == {"sentence"} and kinds[6] == {"line"} and kinds[3] == {"token"}


def test_ranges_agree_with_the_whole(spark):
    text = cues(random.Random(1), 500)
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    for size in (900, 4001, 10**6):
        found = splitting.boundary_tables(splitting.ranges(df, 100, size), size).agg(F.sum("n_tokens")).first()[0]
        assert abs(found - len(ENCODE(text))) <= len(text) // size * 2


@pytest.mark.parametrize("range_chars", [701, 5000])
def test_texts_of_several_blocks_give_the_same_pieces(spark, range_chars):
    rng = random.Random(5)
    texts = {1: cues(rng, 300), 2: "word " * 4000, 3: "я" * 9000, 4: "One sentence of words. " * 900, 5: "😀" * 3000, 6: "short"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = sorted(map(tuple, splitting.split_texts(df, 300, 20, range_chars, block_ranges=1).collect()))
    assert found == sorted(map(tuple, splitting.split_texts(df, 300, 20, range_chars).collect()))


@pytest.mark.parametrize(("block_ranges", "spread"), [(1, None), (3, None), (3, 4)])
def test_blocks_give_the_same_ranges(spark, block_ranges, spread):
    rng = random.Random(2)
    df = spark.createDataFrame([(1, cues(rng, 200)), (2, "x" * 1000), (3, "я" * 5001)], "doc_id bigint, text string")
    whole = sorted(map(tuple, splitting.ranges(df, 1, 1000, 1).collect()))
    assert sorted(map(tuple, splitting.ranges(df, 1, 1000, 1, block_ranges, spread).collect())) == whole
    texts = {r.doc_id: r.text for r in df.collect()}
    for doc, no, start, left, n_chars, part in whole:
        assert n_chars == len(texts[doc]) and start == 1000 * no and part == texts[doc][start - left : start + 1000 + 128]


def test_giant_text(spark):
    text = cues(random.Random(3), 60_000)
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = splitting.split_texts(df).collect()
    assert len(text) > 4_000_000
    check(text, rows, 2000, 100)


def test_limit(spark):
    df = spark.createDataFrame([(1, " a" * 2000), (2, " a" * 2001), (3, " a" * 2001)], "doc_id bigint, text string")
    found = splitting.oversized(df, 2000)
    assert sorted(r.doc_id for r in found.collect()) == [2, 3]


def test_empty_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (None, "x " * 3000), (3, "")], "doc_id bigint, text string")
    assert splitting.split_texts(df.limit(0)).count() == 0
    assert splitting.split_texts(df.filter(F.col("doc_id").isNotNull())).count() == 0


def test_limit_below_overlap():
    with pytest.raises(ValueError):
        splitting.cut_points(*[__import__("numpy").zeros(0, dtype=int)] * 4, 1000, -1, 100, 100)


def test_no_boundary_is_an_error():
    none = [__import__("numpy").zeros(0, dtype=int)] * 4
    with pytest.raises(ValueError, match="no boundary"):
        splitting.cut_points(*none, 5000, 9999, 2000, 100)
