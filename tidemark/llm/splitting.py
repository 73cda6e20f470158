"""Splitting oversized texts at natural boundaries, by ranges with halos, stitched boundary tables and offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import parallelism, staged
from .tokens import TOKENIZER_FILE, tokenizer

#: Characters of a range. A text is cut into ranges before anything looks into it.
RANGE_CHARS = 65_536
#: Ranges of a block. Longer texts are cut into blocks before ranges.
BLOCK_RANGES = 64
#: No token of the vocabulary is longer; a halo of `overlap` times this holds `overlap` tokens.
TOKEN_CHARS = 128
#: A boundary table keeps, for each kind, the last boundary in each run of so many tokens.
BLOCK_TOKENS = 32
#: Pieces are planned so many tokens shorter, as a piece's first and last tokens may split otherwise on their own.
MARGIN = 24

_CUE = re.compile(r"\n(?:[ \t]*\r?\n)+")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?…。！？][\"')\]»”’]*\s+")
CUE, LINE, SENTENCE, TOKEN = 0, 1, 2, 3


def ranges(docs: DataFrame, least_bytes: int, range_chars: int = RANGE_CHARS, overlap: int = 100, block_ranges: int = BLOCK_RANGES, spread: int | None = None) -> DataFrame:
    """Rows doc_id, range_no, start, left (characters of halo before it), n_chars (of the text), part: a slice with its halos.

    Texts of fewer than `least_bytes` UTF-8 bytes are left out: a byte-level vocabulary can't give them more tokens than bytes.
    Texts of more than `block_ranges` ranges are cut into blocks first, as the cost of cutting goes with the place of the cut. With
    `spread` blocks are dealt to so many tasks, so that several work on one text; it moves all text once.
    """
    halo = overlap * TOKEN_CHARS
    block_chars = range_chars * block_ranges
    number = lambda size, each: F.sequence(F.lit(0), F.greatest(((size - 1) / each).cast("int"), F.lit(0)))
    long = docs.select("doc_id", "text").filter(F.octet_length("text") >= least_bytes).withColumn("n_chars", F.char_length("text"))
    blocks = long.withColumn("block", F.explode(number(F.col("n_chars"), block_chars)))
    from_char = F.greatest(F.col("block").cast("bigint") * block_chars - halo, F.lit(0))
    cut = F.substring("text", (from_char + 1).cast("int"), F.lit(block_chars + 2 * halo))
    blocks = blocks.select("doc_id", "block", "n_chars", from_char.alias("from"), F.when(F.col("n_chars") > block_chars, cut).otherwise(F.col("text")).alias("text"))
    if spread:
        blocks = blocks.repartition(spread, "doc_id", "block")
    inside = F.least(F.col("n_chars") - F.col("block").cast("bigint") * block_chars, F.lit(block_chars))
    rows = blocks.withColumn("_r", F.explode(number(inside, range_chars))).withColumn("range_no", F.col("block") * block_ranges + F.col("_r"))
    start = F.col("range_no").cast("bigint") * range_chars
    left = F.least(start, F.lit(halo))
    return rows.select("doc_id", "range_no", start.alias("start"), left.cast("int").alias("left"), "n_chars", F.substring("text", (start - left - F.col("from") + 1).cast("int"), (left + range_chars + halo).cast("int")).alias("part"))


def _token_ends(part: str, encode, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters complete after each token, and whether the token ends with a whole character."""
    ends = np.cumsum(sizes[np.array(encode(part), dtype=np.int64)]) if part else np.zeros(0, dtype=np.int64)
    if part.isascii():
        return ends, np.ones(len(ends), dtype=bool)
    raw = np.frombuffer(part.encode(), dtype=np.uint8)
    starts = np.append((raw & 0xC0) != 0x80, True)
    return (np.cumsum(starts) - 1)[ends], starts[ends]


def _own_bounds(part: str, left: int, width: int, start: int, n_chars: int) -> tuple[int, int]:
    """Where a range's own text begins and ends in its slice: after the first line break from its nominal edges on.

    Neighbours look at the same characters for the edge they share; without a line break in the halo the nominal edge holds.
    """

    def edge(at: int) -> int:
        if at <= 0:
            return 0
        stop = min(len(part), at + TOKEN_CHARS * 8)
        found = part.find("\n", at, stop)
        return found + 1 if found >= 0 else at

    begin = edge(left) if start else 0
    end = len(part) if start + width >= n_chars else edge(left + width)
    return begin, end


def boundary_table(part: str, start: int, left: int, n_chars: int, range_chars: int, overlap: int, encode, sizes: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a range's own text and its boundaries (kind, token, at, back), see `boundary_tables`."""
    begin, end = _own_bounds(part, left, range_chars, start, n_chars)
    own, offset = part[begin:end], start - left + begin
    ends, whole = _token_ends(own, encode, sizes)
    good = np.flatnonzero(whole)
    at, token = ends[good], good + 1
    marks, kinds = [at], [TOKEN]
    for kind, found in ((CUE, _CUE), (LINE, _LINE), (SENTENCE, _SENTENCE)):
        marks.append(np.array([m.end() for m in found.finditer(own)], dtype=np.int64))
        kinds.append(kind)
    kind = np.repeat(kinds, [len(m) for m in marks])
    mark = np.concatenate(marks).astype(np.int64)
    # a boundary inside a token counts from the end of that token on, but cuts where it stands
    before = np.searchsorted(at, mark, "left")
    inside = before < len(at)
    mark, kind, number = mark[inside], kind[inside], token[before[inside]]
    run = kind * (len(ends) // BLOCK_TOKENS + 1) + number // BLOCK_TOKENS
    order = np.lexsort((mark, run))
    last = order[np.append(np.diff(run[order]) != 0, True)] if len(order) else order
    mark, kind, number = mark[last], kind[last], number[last]
    # the overlap may reach into the halo before the range
    halo = part[max(0, begin - overlap * TOKEN_CHARS) : begin] if len(number) and number.min() < overlap else ""
    edges = np.concatenate([_token_ends(halo, encode, sizes)[0] - len(halo), ends])
    back_to = number + len(edges) - len(ends) - overlap
    back = np.where(back_to <= 0, -len(halo), edges[np.maximum(back_to, 1) - 1]) if len(number) else number
    return len(ends), kind, number, mark + offset, back + offset


def boundary_tables(sliced: DataFrame, range_chars: int = RANGE_CHARS, overlap: int = 100, tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """One row per range: doc_id, range_no, n_chars of the text, n_tokens of the range's own text, and arrays of boundaries.

    `kind` is 0 after a blank line (between cues), 1 after a line, 2 after a sentence, 3 after a token; `token` the range's tokens
    before the boundary, `at` its character offset in the text, `back` the offset `overlap` tokens before it (0 if the text has
    fewer). Of each kind the last boundary in a run of BLOCK_TOKENS tokens is kept.
    """

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = tokenizer(tokenizer_file)
        for batch in batches:
            found = [boundary_table(part, start, left, n, range_chars, overlap, encode, sizes) for start, left, n, part in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)))]
            lists = [pa.array([f[i] for f in found], pa.list_(t)) for i, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.int64()), (4, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array([f[0] for f in found], pa.int32()), *lists], names=["doc_id", "range_no", "n_chars", "n_tokens", "kind", "token", "at", "back"])

    kind = sliced.schema["doc_id"].dataType.simpleString()
    return sliced.mapInArrow(tables, f"doc_id {kind}, range_no int, n_chars int, n_tokens int, kind array<int>, token array<int>, at array<bigint>, back array<bigint>")


def stitched(counts: list[int], tables: list[tuple[np.ndarray, ...]]) -> tuple[int, list[np.ndarray]]:
    """Tokens of a text and its boundaries (kind, token, at, back) in order of their token, from those of its ranges in turn."""
    before = np.cumsum(counts) - counts
    kind, token, at, back = (np.concatenate([np.asarray(t[i], dtype=np.int64) for t in tables]) for i in range(4))
    token = token + np.repeat(before, [len(t[0]) for t in tables])
    order = np.lexsort((at, token))
    return int(np.sum(counts)), [x[order] for x in (kind, token, at, back)]


def cut_points(kind: np.ndarray, token: np.ndarray, at: np.ndarray, back: np.ndarray, total: int, n_chars: int, limit: int, overlap: int, margin: int = MARGIN) -> list[tuple[int, int, int, int]]:
    """Pieces (start, end, tokens, kind of the end) from boundaries in order of their token.

    A piece ends at the last cue boundary that keeps it below the limit, else the last line, sentence or token boundary, if that is
    past the overlap; the next starts `overlap` tokens earlier. A text that has none in reach is an error.
    """
    most = limit - 1 - margin
    if most <= overlap:
        raise ValueError("limit must exceed the overlap by more than the margin")
    by_kind = [(token[kind == k], at[kind == k], back[kind == k]) for k in (CUE, LINE, SENTENCE, TOKEN)]
    pieces, start, first, passed = [], 0, 0, 0
    while total - first > most:
        for k, (tokens, ats, backs) in enumerate(by_kind):
            i = int(np.searchsorted(tokens, first + most, "right")) - 1
            if i >= 0 and tokens[i] > passed and tokens[i] > first + overlap and ats[i] > start:
                break
        else:
            raise ValueError(f"no boundary within {most} tokens after character {start}")
        pieces.append((start, int(ats[i]), int(tokens[i] - first), k))
        passed = int(tokens[i])
        start, first = int(backs[i]), passed - overlap
    pieces.append((start, n_chars, total - first, -1))
    return pieces


ENDS = ("cue", "line", "sentence", "token", "end")


def _pieces_of(text: str, limit: int, overlap: int, range_chars: int, encode, sizes: np.ndarray) -> list[tuple[int, int, int, str, str]]:
    """(start, end, tokens, how it ends, text) of the pieces of one text; none if it isn't above the limit.

    A piece's own tokens may differ from those it has in the text, where it is cut inside a word; if that takes one to the limit, all
    are planned anew with a larger margin.
    """
    halo = overlap * TOKEN_CHARS
    counts, tables = [], []
    for start in range(0, len(text), range_chars):
        left = min(start, halo)
        n, *table = boundary_table(text[start - left : start + range_chars + halo], start, left, len(text), range_chars, overlap, encode, sizes)
        counts.append(n)
        tables.append(tuple(table))
    total, found = stitched(counts, tables)
    if total <= limit:
        return []
    margin = MARGIN
    while True:
        cut = [(start, end, text[start:end], ENDS[k]) for start, end, _, k in cut_points(*found, total, len(text), limit, overlap, margin)]
        own = [len(encode(c[2])) for c in cut]
        if max(own) < limit:
            return [(start, end, n, ends_at, piece) for n, (start, end, piece, ends_at) in zip(own, cut)]
        margin += max(own) - limit + MARGIN


def split_texts(docs: DataFrame, limit: int = 2000, overlap: int = 100, range_chars: int = RANGE_CHARS, tokenizer_file: str = TOKENIZER_FILE, block_ranges: int = BLOCK_RANGES) -> DataFrame:
    """Pieces of the texts of more than `limit` tokens: doc_id, piece_no, start, end, n_tokens, ends_at, piece.

    Pieces are below `limit` tokens and end between cues, lines or sentences where the text has such within reach; each begins with
    the last `overlap` tokens of the one before (some bytes more where a token ends inside a character). Cutting the overlaps away
    and joining the rest gives the text back. start and end are character offsets from 0, `ends_at` is cue, line, sentence, token or
    end, n_tokens the tokens of the piece by itself. Null, empty and small texts and null ids give no rows. Rows of one doc_id are each
    split, but giant texts need an id of their own.

    A text of at most `block_ranges` ranges is a block: its task makes the boundary tables of its ranges, stitches them and emits the
    pieces, so nothing is moved. Larger texts are cut into blocks that all tasks share; see `_giant_pieces`.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece_no int, start bigint, end bigint, n_tokens int, ends_at string, piece string"
    long = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.octet_length("text") > limit))
    block_chars = range_chars * block_ranges
    giant = (F.octet_length("text") > block_chars) & (F.char_length("text") > block_chars)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = tokenizer(tokenizer_file)
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                if pieces := _pieces_of(text, limit, overlap, range_chars, encode, sizes):
                    n = len(pieces)
                    columns = [pa.array([p[c] for p in pieces], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * n)), pa.array(range(n), pa.int32()), *columns], names=["doc_id", "piece_no", "start", "end", "n_tokens", "ends_at", "piece"])

    out = long.filter(~giant).mapInArrow(split, schema)
    large = long.filter(giant)
    return out.unionByName(_giant_pieces(large, limit, overlap, range_chars, block_ranges, tokenizer_file, schema)) if large.select("doc_id").take(1) else out


def _giant_pieces(large: DataFrame, limit: int, overlap: int, range_chars: int, block_ranges: int, tokenizer_file: str, schema: str) -> DataFrame:
    """Pieces of texts of several blocks, which are dealt to all tasks.

    Workers make boundary tables of their ranges; those of a text, some 3 KB for a thousand tokens, are stitched in one task, which
    sums the lengths and plans the pieces. The table of cuts is joined to the ranges by (doc_id, range_no); each range emits its slice
    of a piece by offset, and the few that cross are put together. No task holds a whole text after it was cut into blocks. A piece
    that reaches the limit by its own count is an error.
    """
    sliced = staged(ranges(large, limit + 1, range_chars, overlap, block_ranges, parallelism(large.sparkSession)), "ranges")
    tables = boundary_tables(sliced, range_chars, overlap, tokenizer_file)
    kind = large.schema["doc_id"].dataType.simpleString()

    def plan(group: pa.Table) -> pa.Table:
        group = group.sort_by("range_no")
        lists = [group.column(k).to_pylist() for k in ("kind", "token", "at", "back")]
        total, found = stitched(group.column("n_tokens").to_pylist(), list(zip(*lists)))
        rows = cut_points(*found, total, group.column("n_chars")[0].as_py(), limit, overlap) if total > limit else []
        return pa.table({
            "doc_id": group.column("doc_id").slice(0, 1).combine_chunks().take(pa.array([0] * len(rows), pa.int64())), "piece_no": pa.array(range(len(rows)), pa.int32()), "start": pa.array([r[0] for r in rows], pa.int64()),
            "end": pa.array([r[1] for r in rows], pa.int64()), "ends_at": pa.array([ENDS[r[3]] for r in rows], pa.string()),
        })

    cut = tables.groupBy("doc_id").applyInArrow(plan, f"doc_id {kind}, piece_no int, start bigint, end bigint, ends_at string")
    number = lambda at: F.floor(at / range_chars).cast("int")
    parts = cut.withColumn("range_no", F.explode(F.sequence(number(F.col("start")), number(F.col("end") - 1))))
    held = sliced.select("doc_id", "range_no", F.col("start").alias("_at"), "left", "part")
    low, high = F.greatest("start", "_at"), F.least(F.col("end"), F.col("_at") + range_chars)
    own = F.substring("part", (F.col("left") + low - F.col("_at") + 1).cast("int"), (high - low).cast("int"))
    parts = parts.join(held, ["doc_id", "range_no"]).groupBy("doc_id", "piece_no", "start", "end", "ends_at").agg(F.sort_array(F.collect_list(F.struct("range_no", own.alias("own")))).alias("_parts"))
    whole = parts.select("doc_id", "piece_no", "start", "end", "ends_at", F.array_join(F.transform("_parts", lambda x: x["own"]), "").alias("piece"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = tokenizer(tokenizer_file)
        for batch in batches:
            n = [len(encode(x)) for x in batch.column(5).to_pylist()]
            if max(n, default=0) >= limit:
                raise ValueError(f"a piece of a giant text has {max(n)} tokens by itself")
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int32()), batch.column(4), batch.column(5)], names=["doc_id", "piece_no", "start", "end", "n_tokens", "ends_at", "piece"])

    return whole.mapInArrow(count, schema)


def oversized(docs: DataFrame, limit: int = 2000, overlap: int = 100, **options) -> DataFrame:
    """doc_id of the texts above `limit` tokens: those that `split_texts` has pieces of, once for each row of the id."""
    return split_texts(docs, limit, overlap, **options).filter("piece_no = 0").select("doc_id")
