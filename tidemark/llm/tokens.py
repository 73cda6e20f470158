"""Sizes in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Folder of the vocabulary files; a parameter of every operator that counts tokens.
TOKENIZER_FILE = os.environ.get("TIDEMARK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# fixed value: the splitting pattern that belongs to the vocabulary
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts of more characters are given to the library in parts, as it fails on very long runs of white space.
PART_CHARS = 100_000
#: A run of white space of so many characters is encoded as the one piece that the splitting pattern makes of it.
BLANK_CHARS = 20_000
_BLANK = r"[^\S\x1c-\x1f]"  # white space as the splitting pattern knows it
_WORD_END = re.compile(rf"(?<!{_BLANK})(?={_BLANK})")
_BLANKS = re.compile(rf"{_BLANK}{{{BLANK_CHARS},}}")
_LOADED: dict[str, tuple] = {}


def parts(text: str) -> Iterator[tuple[str, bool]]:
    """`text` cut where the splitting pattern always ends a match, so the parts have the text's own tokens; and whether a part is a single
    match: a long run of white space, without its last character if a word follows."""
    start = 0
    while start < len(text):
        found = _WORD_END.search(text, start + PART_CHARS) if len(text) - start > PART_CHARS else None
        end = found.start() if found else len(text)
        at = start
        for run in _BLANKS.finditer(text, start, end):
            stop = run.end() if run.end() == len(text) else run.end() - 1
            if run.start() > at:
                yield text[at : run.start()], False
            yield text[run.start() : stop], True
            at = stop
        if at < end:
            yield text[at:end], False
        start = end


def tokenizer(path: str):
    """(encode function, bytes of each token id), loaded once in a worker."""
    import tiktoken

    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        own = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        whole, single = own.encode_ordinary, own._encode_single_piece
        _LOADED[path] = (lambda text: whole(text) if len(text) <= PART_CHARS else [t for part, run in parts(text) for t in (single(part) if run else whole(part))]), sizes
    return _LOADED[path]


def token_sizes(docs: DataFrame, text: str = "text", name: str = "n_tokens", tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """`docs` with the column `text` replaced by its number of tokens, `name`.

    Null and empty texts have 0 tokens. Whole texts are counted. Other columns pass through unchanged; a column called `name`
    is replaced.
    """
    kept = [c for c in docs.columns if c not in (text, name)]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(name, T.IntegerType(), False)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = tokenizer(tokenizer_file)
        for batch in batches:
            sizes = [len(encode(x)) if x else 0 for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sizes, pa.int32())], names=[*kept, name])

    return docs.select(*kept, text).mapInArrow(count, schema)
