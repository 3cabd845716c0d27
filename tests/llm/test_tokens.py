"""Token counts, encoding, normalisation and splicing, against the library."""

import hashlib

import numpy as np
import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from aerolith.llm import encoding, pieces, queries, token_counts  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "  two  spaces ", "tab\tand\nline\r\n", "ünïcödé 漢字 🙂 ▁ mark", "<s> </s> <unk> [INST]", "x" * 3000, "word " * 2000, "\x00 nul", "é" * 500]
SCHEMA = "doc_id long, text string, lang string, n_tokens int, id string, data string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 7, "x", None) for i, t in enumerate(TEXTS)] + [(None, "null id", None, None, None, None), (3, "a", "en", 7, "x", None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_counts(docs, library):
    rows = token_counts.count_tokens(docs, PATH, chunk_chars=100, overlap_chars=4).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text)))
        assert r.over_limit == (r.n_tokens > 4096)


@pytest.mark.parametrize("chunk,overlap", [(7, 1), (20, 2), (64, 8), (300, 3)])
def test_splices_are_exact(library, chunk, overlap, sf_dir):
    import duckdb

    texts = [t for t in TEXTS if t] + [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet' LIMIT 25").fetchall()]
    for text in texts:
        assert [i for run in token_counts.spliced(text, PATH, chunk, overlap) for i in run] == library.encode(text)


def test_a_text_without_stable_places_is_encoded_whole(library):
    text = "a" * 5000
    assert [i for run in token_counts.spliced(text, PATH, 50, 4) for i in run] == library.encode(text)


def test_encoding(docs, library):
    rows = encoding.encode_documents(docs, PATH, outputs=("ids", "begins", "ends", "decoded", "covered_bytes")).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert r.ids == library.encode(text)
        assert r.decoded == library.decode(r.ids)
        assert r.covered_bytes == len(text.encode())
        raw = text.encode()
        for i, begin, end in zip(r.ids, r.begins, r.ends, strict=True):
            piece = library.id_to_piece(i)
            surface = bytes([int(piece[3:5], 16)]) if library.is_byte(i) else piece.replace("▁", " ").encode()
            assert raw[begin:end] in (surface, surface.removeprefix(b" "), raw[begin:end] if "▁" in text else surface)


def test_digests(docs, library):
    for r in encoding.digests(encoding.encode_documents(docs, PATH, outputs=("ids", "decoded", "covered_bytes"))).collect():
        ids = library.encode("null id" if r.doc_id is None else TEXTS[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def _compiled(pairs):
    """A tiny map of one-byte or longer keys in the model format, built by placing every child at a free unit."""
    trie: dict = {}
    for key, value in pairs.items():
        node = trie
        for b in key:
            node = node.setdefault(b, {})
        node[None] = value
    pool, where = b"", {}
    for value in pairs.values():
        where[value] = len(pool)
        pool += value + b"\0"
    units = {0: 0}

    def place(at, node):
        labels = [0 if k is None else k for k in node]
        base = 256
        while any((base ^ x) in units for x in labels):
            base += 256
        units[at] = (units[at] & 0x1FF) | ((at ^ base) << 10) | (256 if None in node else 0)
        for k in node:
            units[base ^ (0 if k is None else k)] = 0x80000000 | where[node[None]] if k is None else k
        for k, child in node.items():
            if k is not None:
                place(base ^ k, child)

    place(0, trie)
    table = np.zeros(max(units) + 256, np.uint32)
    for at, unit in units.items():
        table[at] = unit
    return len(table.tobytes()).to_bytes(4, "little") + table.tobytes() + pool


def test_longest_prefix_normalisation():
    table = pieces.CharacterMap.of(_compiled({"ﬁ".encode(): b"fi", b"a": b"A", b"ab": b"X", "Ａ".encode(): b"A"}))
    assert table.longest(b"abc", 0) == (2, b"X")
    assert table.longest(b"ac", 0) == (1, b"A")
    assert table.longest(b"bc", 0) is None
    model = pieces.read(PATH)
    model = pieces.Pieces(**{**{f: getattr(model, f) for f in model.__dataclass_fields__}, "map": table})
    wide, source = model.normalise("ﬁ ab é".encode())
    assert wide.tobytes().decode() == "fi▁X▁é"
    # both letters come from the ligature at 0, the marks from their spaces, X from the two letters at 4
    assert source.tolist() == [0, 0, 3, 3, 3, 4, 6, 6, 6, 7, 8, 9]


def _message(*fields):
    """A protocol buffer of (number, value): bytes, an integer, or a float."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@pytest.fixture(scope="module")
def small_model(tmp_path_factory):
    """Written by hand: no byte fallback, a compiled map, user-defined pieces, squeezed white space."""
    held = [("<unk>", 2), ("<s>", 3), ("</s>", 3), ("ab", 4), ("<a>", 4), ("▁", 1), ("a", 1), ("b", 1), ("A", 1), ("fi", 1), ("f", 1), ("i", 1), ("▁a", 1), ("bb", 1)]
    parts = [(1, _message((1, x.encode()), (2, -float(i)), (3, kind))) for i, (x, kind) in enumerate(held)]
    table = _compiled({"ﬁ".encode(): b"fi", "Ａ".encode(): b"A", "ª".encode(): b"a", b"\t": b" "})
    model = _message(*parts, (2, _message((3, 2))), (3, _message((1, b"own"), (2, table), (3, 1), (4, 1), (5, 1))))
    path = tmp_path_factory.mktemp("model") / "small.model"
    path.write_bytes(model)
    return str(path)


@pytest.mark.parametrize("raw", [b"", b"a b", "ab <a>ab ﬁ Ａbb".encode(), "  x ªb  \t yz漢字a🙂 ".encode(), "ab漢ab".encode(), b"a\xffb", b"\xe6\xbc \xf0\x9f\x99", b"\x80" * 5, "a\ufffdb".encode() + b"\xc3"])
def test_unknown_pieces_user_pieces_and_bad_bytes(spark, small_model, raw):
    for path in (small_model, PATH):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        (row,) = encoding.encode_documents(spark.createDataFrame([(1, bytearray(raw))], "doc_id long, text binary"), path).collect()
        read = raw.decode("utf-8", "replace")
        assert row.ids == library.encode(read) and row.decoded == library.decode(row.ids)
        # the library's own places, in bytes of what it read, brought back to bytes of the raw text
        source = encoding._replaced(raw)
        for begin, end, piece in zip(row.begins, row.ends, library.encode(read, return_type="proto").pieces, strict=True):
            if not library.is_byte(piece.id) and piece.surface.strip():
                shown = raw[source[piece.begin] : source[piece.end]]
                assert raw[begin:end].strip() == shown.strip()
        (count,) = token_counts.count_tokens(spark.createDataFrame([(1, bytearray(raw))], "doc_id long, text binary"), path, chunk_chars=3, overlap_chars=1).collect()
        assert (count.n_bytes, count.n_tokens) == (len(raw), len(row.ids))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(empty, PATH).count() == 0
    assert encoding.encode_documents(empty, PATH).count() == 0


def test_queries_cover_their_table(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert queries.QUERIES["op1_token_counts"](spark, sf_dir).count() == n
    assert queries.QUERIES["op3_sentencepiece"](spark, sf_dir).count() == n


def test_places_of_replaced_bytes():
    import time

    from aerolith.llm import encoding

    rng = np.random.default_rng(1)
    for raw in [b"", b"ok", b"\xff", b"a\xffb", b"\xe2\x82", b"\xe2\x82a\xf0\x9f\x98", "ü�".encode() + b"\x80", *(rng.integers(0, 256, 40).astype(np.uint8).tobytes() for _ in range(50))]:
        want, at = [], 0
        while at < len(raw):
            try:
                raw[at:].decode()
                good, bad = len(raw) - at, None
            except UnicodeDecodeError as error:
                good, bad = error.start, error.end
            want += [*range(at, at + good), *([at + good] * 3 if bad else [])]
            at += bad or good
        assert encoding._replaced(raw).tolist() == [*want, len(raw)]
    began = time.perf_counter()
    assert len(encoding._replaced(b"\xff" * 1_000_000)) == 3_000_001
    assert time.perf_counter() - began < 20
