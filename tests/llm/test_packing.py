import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stockwarden.llm import packing
from stockwarden.llm.queries import vocabulary
from tests.llm.fixtures import docs, no_docs, odd_docs, prose


def filled(counts, runs):
    """Each sequence's (offset, length) from the runs; every piece must be placed once."""
    out, seen = {}, {}
    for length, rank, n, first, each, offset in runs.tolist():
        for k in range(n):
            out.setdefault(first + k // each, []).append((offset + k % each * length, length))
        seen.setdefault(length, []).append((rank, n))
    for length, parts in seen.items():
        at = 0
        for rank, n in sorted(parts):
            assert rank == at
            at += n
        assert at == counts[length]
    assert {x for x in range(len(counts)) if counts[x]} == set(seen)
    for places in out.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= len(counts) - 1
    return out


@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 12))
@settings(max_examples=150, deadline=None)
def test_plans_are_whole_and_gapless(lengths, groups):
    counts = np.bincount(lengths, minlength=65)
    used = filled(counts, packing.plan(counts, groups=groups))
    assert len(used) >= -(-sum(lengths) // 64)


def test_plans_are_near_the_least_number(spark):
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(6, 1.1, 20_000).astype(int), 1, 4096)
    counts = np.bincount(lengths, minlength=4097)
    used = filled(counts, packing.plan(counts))
    assert len(used) <= 1.01 * -(-lengths.sum() // 4096)


def test_ids_of_words_equal_ids_of_whole_texts():
    known = packing.WordIds(vocabulary())
    texts = ["", "Hello, world's  end!", "ÉÉ é́ x y z", "a<|endoftext|>b <|startoftext|>", "\x1c\x1d a\x1fb \x85c", "ΣΑΣ İ ǅ", "12345 ２ Ⅷ", prose(1, 500), "日本語 한글 😀😀"]
    for text in texts * 2:
        assert np.frombuffer(known.of(text), "<u4").tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    known, fresh = packing.WordIds(vocabulary()), packing.WordIds(vocabulary())
    for k in range(20):
        assert known.of(prose(k % 3, 12)) == np.array(fresh.tokenizer.encode(prose(k % 3, 12), add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("numbered", [250_000, 10])
def test_pieces_round_trip(spark, monkeypatch, numbered):
    monkeypatch.setattr(packing, "NUMBERED", numbered)
    texts = [prose(k, 3 + 7 * k % 400) for k in range(120)] + [prose(7, 3 + 49)] * 40
    rows = packing.pack(docs(spark, texts), vocabulary(), capacity=256).collect()
    whole, place = {}, {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 256
        whole.setdefault(r.doc_id, []).append((r.piece, r.start, r.ids))
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    known = packing.WordIds(vocabulary())
    for k, text in enumerate(texts):
        parts = sorted(whole[k])
        assert [p[0] for p in parts] == list(range(len(parts)))
        ids = [i for _, _, own in parts for i in own]
        assert ids == [*np.frombuffer(known.of(text), "<u4").tolist(), 1]
        assert [p[1] for p in parts] == [256 * n for n in range(len(parts))] and all(len(p[2]) == 256 for p in parts[:-1])
    for own in place.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256


def test_odd_rows(spark):
    rows = packing.pack(odd_docs(spark), vocabulary(), keep_ids=False).collect()
    assert len({(r.doc_id, r.piece) for r in rows}) >= 10
    blank = [r for r in rows if r.doc_id in (2, 3, 4)]
    assert all(r.length == 1 and r.ids_crc32 == zlib.crc32(b"\1\0\0\0") for r in blank) and len(blank) == 3
    assert sum(r.doc_id == 1 for r in rows) == 2
    assert packing.pack(no_docs(spark), vocabulary()).count() == 0


def test_few_texts_are_split_into_words_at_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "TOGETHER", 1000)
    texts = [None, "a" * 400, "b" * 400, "c" * 5000, "", None, "d" * 300, "e" * 900, "f"]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(9)), "text": pa.array(texts, pa.string())})
    parts = [p.column("text").to_pylist() for p in packing._slices(batch)]
    assert sum(parts, []) == texts and all(parts)
    assert all(len(p) == 1 or sum(len(t or "") for t in p[1:]) <= 1000 for p in parts) and len(parts) >= 4
    assert [p.num_rows for p in packing._slices(batch.slice(0, 0))] == [0]
    assert [p.num_rows for p in packing._slices(batch.slice(0, 1))] == [1]


def test_memory_of_batches_is_given_back_after_the_last(monkeypatch):
    import pyarrow as pa
    from stockwarden.llm import common

    done = []
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: done.append(1)})())
    run = common.giving_back(lambda batches: (b.slice(1) for b in batches))(iter([pa.RecordBatch.from_pydict({"x": [1, 2]})] * 2))
    assert [next(run).num_rows, next(run).num_rows, done] == [1, 1, []]
    assert list(run) == [] and done == [1]
