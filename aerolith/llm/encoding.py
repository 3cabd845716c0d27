"""Operator 3, SentencePiece encoding and decoding with offsets.

The library finds the merges. Normalisation is done here a second time, by longest prefix through the model's compiled
character map, because it must say where every normalised byte came from: the pieces' widths run along those bytes, and
so every piece is projected to a span of bytes of the original text. A text whose pieces do not cover its normalised
form exactly is an error, not a guess.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm import common, pieces

OUTPUTS = {"ids": "array<int>", "begins": "array<int>", "ends": "array<int>", "decoded": "string", "covered_bytes": "long"}


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", outputs: Sequence[str] = ("ids", "begins", "ends", "decoded")) -> DataFrame:
    """(id, *outputs) for every row of docs; outputs are keys of OUTPUTS.

    ids: all pieces, without begin or end ids. begins, ends: each piece's span of bytes of the original text. decoded:
    the library's decoding of the ids. covered_bytes: original bytes within the pieces' spans. A null text counts as
    empty: no ids, an empty decoding. Bytes that are not UTF-8 are read as U+FFFD, as `str.decode` replaces them, and spans
    point to the bytes replaced. Texts are encoded whole, several short ones or one long one at a time. A null id is kept;
    repeated rows each give a row, of equal texts an equal one, so there are no ties; an empty table gives no rows; other columns are not read.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, library = pieces.read(tokenizer), pieces.processor(tokenizer)
        for batch in batches:
            for lo, hi in common.blocks(batch.column(1)):
                texts = batch.column(1)[lo:hi].to_pylist()
                read = [x.decode("utf-8", "replace") for x in texts]
                found = library.encode(read, num_threads=1)
                ids = [np.array(x, np.int32) for x in found]
                spans = [_spans(model, library, i, x, y) for i, x, y in zip(ids, texts, read, strict=True)]
                made = {
                    "ids": lambda: _lists(ids),
                    "begins": lambda: _lists([x.astype(np.int32) for x, _ in spans]),
                    "ends": lambda: _lists([x.astype(np.int32) for _, x in spans]),
                    "decoded": lambda: pa.array(library.decode(found, num_threads=1) if found else [], pa.string()),
                    "covered_bytes": lambda: pa.array([_covered(a, b) for a, b in spans], pa.int64()),
                }
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], *(made[k]() for k in outputs)], ["id", *outputs])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"{k} {OUTPUTS[k]}" for k in outputs)])
    out = docs.select(F.col(id_col).alias("id"), common.as_bytes(text_col).alias("data")).mapInArrow(encoded, schema)
    return out.select(F.col("id").alias(id_col), *outputs)


def _spans(model: pieces.Pieces, library, ids: np.ndarray, raw: bytes, read: str) -> tuple[np.ndarray, np.ndarray]:
    shown = library.encode(read, out_type=str) if (ids == model.unknown).any() else None
    if "\ufffd" not in read or raw == (seen := read.encode()):
        return model.spans(ids, raw, shown)
    source = _replaced(raw)
    return tuple(source[x] for x in model.spans(ids, seen, shown))


_BAD: list[tuple[int, int]] = []


def _note(error: UnicodeError) -> tuple[str, int]:
    _BAD.append((error.start, error.end))
    return "\ufffd", error.end


codecs.register_error("aerolith_note", _note)


def _replaced(raw: bytes) -> np.ndarray:
    """For each byte of the text with bad bytes replaced the place it comes from, and the end; one pass."""
    _BAD.clear()
    raw.decode("utf-8", "aerolith_note")
    parts, at = [], 0
    for begin, end in _BAD:
        parts += [np.arange(at, begin), np.full(len("\ufffd".encode()), begin)]
        at = end
    return np.concatenate([*parts, np.arange(at, len(raw) + 1)])


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)])))


def _covered(begins: np.ndarray, ends: np.ndarray) -> int:
    """Bytes in the union of spans whose begins and ends both rise."""
    if not len(ends):
        return 0
    reached = np.concatenate([[0], np.maximum.accumulate(ends)[:-1]])
    return int(np.maximum(ends - np.maximum(begins, reached), 0).sum())


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from what encode_documents returned."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        "covered_bytes",
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, digest of their decoding, and the bytes that the pieces' spans cover."""
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return digests(encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), outputs=("ids", "decoded", "covered_bytes")))
