"""Operator 1, token counts: overlap resynchronisation.

A huge text is encoded in overlapping chunks. Widths of the pieces give every token's place in the text. Two chunks are
spliced at a boundary that both have and that is proven stable: no piece of the vocabulary joins the characters on its
two sides, so no merge of the whole text can cross it, and the tokens on either side depend on that side alone. If the
overlap holds no such place, it is doubled, in the end to the whole of both chunks, which are then encoded as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import common, pieces

#: Characters from which a text is encoded in chunks, characters of a chunk, and of the first overlap.
CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 256


def spliced(text: str, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[list[int]]:
    """The ids of the whole text, in runs. Texts of one chunk, and models for which no splice is proven, are encoded whole."""
    model, library = pieces.read(path), pieces.processor(path)
    if len(text) <= chunk or not model.splits_safely:
        yield library.encode(text)
        return
    lead = int(model.dummy_prefix)

    def encoded(lo: int, hi: int) -> tuple[list[int], np.ndarray]:
        ids = library.encode(text[lo:hi])
        return ids, np.cumsum(model.chars[ids]) - lead + lo

    # start is 0 or a stable place; a chunk that begins there is read from the character before, whose tokens are dropped
    start, end = 0, chunk
    ids, ends = encoded(start, end)
    while end < len(text):
        width, floor = overlap, max(start - 1, 0)
        while True:
            lo = max(floor, end - width)
            hi = min(len(text), end + max(chunk, end - start))
            next_ids, next_ends = encoded(lo, hi)
            cut = _common(model, text, ends, next_ends, max(lo, start) + 1, end)
            if cut is not None or lo == floor:
                break
            width *= 2
        if cut is not None:
            yield ids[: int(np.searchsorted(ends, cut, side="right"))]
            keep = int(np.searchsorted(next_ends, cut, side="right"))
            ids, ends, start = next_ids[keep:], next_ends[keep:], cut
        else:
            keep = int(np.searchsorted(next_ends, start, side="right")) if start else 0
            ids, ends = next_ids[keep:], next_ends[keep:]
        end = hi
    yield ids


def _common(model: pieces.Pieces, text: str, left: np.ndarray, right: np.ndarray, lo: int, hi: int) -> int | None:
    """The last place in lo..hi-1 where both chunks have a boundary that is proven stable."""
    both = np.intersect1d(left, right)
    for at in both[np.searchsorted(both, lo) : np.searchsorted(both, hi)][::-1].tolist():
        if model.stable(text[at - 1], text[at]):
            return at
    return None


def count_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096,
    chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of docs.

    tokenizer: path of a SentencePiece model, the same on every node. A null text counts as empty: no bytes, no tokens.
    Bytes that are not UTF-8 are read as U+FFFD. Texts over chunk_chars are encoded in chunks, one text at a time. A null id
    is kept. Repeated rows each give a row. An empty table gives no rows. Other columns of docs are not read.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = pieces.processor(tokenizer)
        for batch in batches:
            sizes = np.diff(common.offsets(batch.column(1))).astype(np.int64)
            found: list[int] = []
            for lo, hi in common.blocks(batch.column(1)):
                texts = [x.decode("utf-8", "replace") for x in batch.column(1)[lo:hi].to_pylist()]
                short = iter(library.encode([x for x in texts if len(x) <= chunk_chars], num_threads=1))
                found += [len(next(short)) if len(x) <= chunk_chars else sum(map(len, spliced(x, tokenizer, chunk_chars, overlap_chars))) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(found, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), common.as_bytes(text_col).alias("data")).mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether the tokens are more than 4096."""
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
