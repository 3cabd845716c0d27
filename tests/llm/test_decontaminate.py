import random

import pytest

from aerolith.llm import decontaminate


def slow(pattern, text):
    """Least edits of the pattern against any substring."""
    last = list(range(len(pattern) + 1))
    best = last[-1]
    for ch in text:
        row = [0]
        for i, p in enumerate(pattern, 1):
            row.append(min(last[i - 1] + (p != ch), last[i] + 1, row[-1] + 1))
        last = row
        best = min(best, last[-1])
    return best


def words(n, rng):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_by_brute_force():
    rng = random.Random(4)
    items = [(i, words(rng.randint(6, 60), rng).encode()) for i in range(12)]
    (index,) = decontaminate.Index.of(items)
    texts = []
    for _ in range(25):
        segment = bytearray(index.segments[rng.randrange(len(index.segments))])
        for _ in range(rng.randint(0, len(segment) // 8)):
            k, kind = rng.randrange(len(segment)), rng.random()
            if kind < 0.4:
                segment[k] = rng.choice(b"abcxyz")
            elif kind < 0.7:
                del segment[k]
            else:
                segment.insert(k, rng.choice(b"abcxyz"))
        texts.append(decontaminate.normalised(words(20, rng).encode() + b" " + bytes(segment) + b" " + words(10, rng).encode()))
    found = {(t, s): e for t, s, _, _, e in decontaminate.matches(index, texts)}
    for t, text in enumerate(texts):
        for s, segment in enumerate(index.segments):
            edits = slow(segment, text)
            assert found.get((t, s)) == (edits if edits <= index.budget[s] else None)


def edited(item, edits, rng):
    """So many edits at different places, with letters that the item does not have."""
    out = bytearray(item)
    for k in sorted(rng.sample(range(len(item)), edits), reverse=True):
        kind = rng.random()
        if kind < 0.5:
            out[k] = rng.choice(b"xyz")
        elif kind < 0.75:
            del out[k]
        else:
            out.insert(k, rng.choice(b"xyz"))
    return bytes(out)


def spread(item, edits):
    """Substitutions at even distances, which leave the fewest shared q-grams."""
    out = bytearray(item)
    for k in range(edits):
        out[(2 * k + 1) * len(item) // (2 * edits)] = ord("z")
    return bytes(out)


def test_every_length_with_all_its_edits_is_found():
    rng = random.Random(5)
    for size in range(1, 241):
        item = bytes(rng.choice(b"abcdefghij") for _ in range(size))
        indexes = decontaminate.Index.of([(7, item)])
        assert all((index.least >= 1).all() for index in indexes)
        budget = decontaminate.budget_of(min(size, decontaminate.WINDOW))
        for text in (item, spread(item, budget), edited(item, budget, rng)):
            text = decontaminate.normalised(words(8, rng).encode() + b" " + text + b" " + words(8, rng).encode())
            found = list(decontaminate.found_in(indexes, [b"", text]))
            least = [slow(window, text) for window in decontaminate.windows(item)]
            assert {(t, i) for t, i, *_ in found} == {(1, 7)} and min(e for *_, e in found) == min(least), size


def test_items_without_edits_are_whole_words():
    indexes = decontaminate.Index.of([("a", b"cat"), ("b", b"a b")])
    found = {(t, i, x, y) for t, i, x, y, _ in decontaminate.found_in(indexes, [b"concat cats", b"cats cat", b"aa b a b", b"Cat", b"a  b"])}
    assert found == {(1, "a", 5, 8), (2, "b", 5, 8), (3, "a", 0, 3), (4, "b", 0, 3)}


def test_ids_keep_their_types(spark):
    docs = spark.createDataFrame([("x", "some text that says a thing")], "doc_id string, text string")
    bench = spark.createDataFrame([("item-1", "text that says a thing"), ("item-2", None), ("item-3", " ")], "item_id string, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()] == [("x", "item-1")]


def test_rows_and_spans(spark):
    item = "The quick brown fox jumps over the lazy dog while nobody at all is looking at it"
    rows = [(1, f"start {item} end"), (2, item.upper().replace(" ", "\n  ")), (3, "nothing of the kind here " * 20), (4, None), (5, ""), (None, item), (1, f"start {item} end"), (6, item.replace("quick", "quack"))]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, item), (8, item), (9, "short"), (None, item), (10, None)], "item_id long, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == sorted([(i, k) for i in (1, 1, 2, None, 6) for k in (7, 8)], key=str)
    for r in found:
        if r.doc_id == 1:
            assert f"start {item} end"[r.begin : r.end] == item and r.edits == 0
        if r.doc_id == 6:
            assert r.edits == 1
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]


def test_empty_tables_and_blocks(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    none_d, none_b = docs.limit(0), bench.limit(0)
    assert decontaminate.contaminated(none_d, bench).count() == 0
    assert decontaminate.contaminated(docs, none_b).count() == 0
    assert decontaminate.clean(docs, none_b).count() == docs.count()
    whole = {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 2000)
    assert {tuple(r) for r in decontaminate.contaminated(docs, bench).collect()} == whole and whole
    assert decontaminate.clean(docs, bench).count() == docs.count() - len({r[0] for r in whole})


@pytest.mark.parametrize("text", [b"", b"  a \t b\n", "ünï  x".encode()])
def test_source_places(text):
    shown = decontaminate.normalised(text)
    source = decontaminate._source(text)
    assert [bytes([shown[i]]) for i in range(len(shown))] == [text[source[i] : source[i] + 1].lower().replace(b"\n", b" ").replace(b"\t", b" ") for i in range(len(shown))]


def test_any_place_of_an_item_without_edits_counts():
    """A place that does not stand alone hides no other, whatever longer items are looked for too."""
    rng = random.Random(7)
    long = bytes(rng.choice(b"klmnop") for _ in range(160))
    indexes = decontaminate.Index.of([(1, b"cat sat on"), (2, long), (3, b"cat sat on it")])
    for before in ("abcdefgh ", "abcdefghi ", "", "x" * 40 + " "):
        for text in (f"{before}xcat sat on cat sat on", f"{before}xcat sat on " * 30 + "cat sat on", f"cat sat onx {before}cat sat on"):
            found = list(decontaminate.found_in(indexes, [text.encode(), b"cat sat only", long]))
            assert (0, 1, text.rfind("cat sat on"), len(text), 0) in found and {(t, i) for t, i, *_ in found} == {(0, 1), (2, 2)}


def test_texts_that_repeat_a_window_are_taken_in_pieces(monkeypatch):
    import tracemalloc

    item = b"ab" * 80
    (index,) = decontaminate.Index.of([(1, item)])
    some = [b"ab" * 3000, b"xy " * 500 + b"ab" * 79 + b" xy" * 500, b"ab" * 300 + b"cd" * 300 + b"ab" * 76 + b"c"]
    want = decontaminate.matches(index, some)
    assert {t for t, *_ in want} == {0, 1, 2}
    for places in (1, 5000, 100_000):
        monkeypatch.setattr(decontaminate, "PLACES", places)
        assert decontaminate.matches(index, some) == want
    monkeypatch.undo()
    tracemalloc.start()
    assert len(decontaminate.matches(index, [b"ab" * 500_000])) == 1
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
