"""Groups, links and corpus counts of two tokenizers against a plain walk over their bytes."""

import hashlib

import numpy as np
import public_tokenizers
import pytest

from quern.llm import token_align as T
from tests.llm.conftest import DATA

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
HARD = [
    "", None, " ", "  a", "a  ", "▁x", "<s> </s> <|endoftext|> <unk> <0x41>", "\x00 x\n\n\ty", "日本語 テスト ü İ ß", "a" * 5000, "  \n  x   y\n", "▁", "word " * 30000, "\n", "\n\n a\nb",
    "x" * 300 + " " + "ő" * 300, "same text twice", "same text twice", "\r\n\r\n  \t ", "é​﻿ \U0001f600",
]


def cuts(parts):
    ends, total = [], 0
    for p in parts:
        total += len(p)
        ends.append(total)
    return ends


def walked(text, a, b):
    """Groups of one text by walking the ends of both sides; None where it has no tokens."""
    if not text:
        return None
    own_a, own_b = a.library.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)
    parts_a, parts_b, whole = [a.bytes[i] for i in own_a], [b.bytes[i] for i in own_b], b" " + text.encode()
    if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
        return None
    ends_a, ends_b = cuts(parts_a), cuts(parts_b)
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        p, q = i, j
        while i < len(ends_a) and ends_a[i] <= cut:
            i += 1
        while j < len(ends_b) and ends_b[j] <= cut:
            j += 1
        groups.append((own_a[p:i], own_b[q:j]))
    return groups


def plain(texts):
    a, b = T.load(A, B)
    found = [walked(t, a, b) for t in texts]
    counts, most = {}, {}
    for groups in found:
        for pair in {(x, y) for p, q in groups or [] for x in p for y in q}:
            counts[pair] = counts.get(pair, 0) + 1
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for groups in found:
        links = [(x, y) for p, q in groups or [] for x in p for y in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups or [])
        sizes = sum(len(p) for p, _ in groups or []), sum(len(q) for _, q in groups or []), len(groups or [])
        out.append((*sizes, len(links), sum(counts[k] == most[k[0]] for k in links), sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


@pytest.mark.parametrize("block", [20_000, 4_000_000])
def test_alignment_equals_walk(spark, texts, block, monkeypatch):
    rows = [*HARD, *(texts[i] for i in sorted(texts))]
    T_block = T.BLOCK
    try:
        T.BLOCK = block
        table = spark.createDataFrame([(i, t, 1, "clash") for i, t in enumerate(rows)], "doc_id long, text string, _block int, pair string").repartition(3)
        got = {r.doc_id: tuple(r[f] for f in FIELDS) for r in T.align(table, A, B).collect()}
    finally:
        T.BLOCK = T_block
    want = plain(rows)
    assert len(got) == len(rows)
    assert [i for i, w in enumerate(want) if got[i] != w] == []


def test_links_of_large_groups_are_counted_by_distinct_ids(texts, monkeypatch):
    a, b = T.load(A, B)
    some = [*HARD, *(texts[i] for i in sorted(texts)[:40])]
    by_link = T.Block(some, a, b).pairs()
    monkeypatch.setattr(T, "LINKS_AT_ONCE", 1)
    by_ids = T.Block(some, a, b).pairs()
    assert all(np.array_equal(p, q) for p, q in zip(by_link, by_ids))


def test_long_texts_take_the_other_library_with_equal_ids(texts, monkeypatch):
    a, b = T.load(A, B)
    some = [t for t in [*HARD, *(texts[i] for i in sorted(texts)[:40])] if t]
    fast = [a.ids(t) for t in some]
    monkeypatch.setattr(T, "LONG_TEXT", 0)
    assert all(np.array_equal(p, a.ids(t)) for p, t in zip(fast, some))
    whole = [b.model.encode(t) for t in some]
    assert all(own is None or own.tolist() == w for own, w in zip(map(b.ids, some), whole))


def test_jump_follows_long_chains():
    n = 10_000
    ends_a, ends_b = np.arange(2, 2 * n + 2, 2), np.append(np.arange(1, 2 * n, 2), 2 * n)  # overlap all the way, one cut
    one, two = T.group_numbers(ends_a, ends_b)
    assert one.max() == two.max() == 0 and len(one) == n


def test_groups_are_rows(spark):
    a, b = T.load(A, B)
    rows = T.groups(spark.createDataFrame([(1, "ünïcode text"), (2, None), (3, "x")], "doc_id long, text string"), A, B).orderBy("doc_id", "group").collect()
    assert [(list(r.a_ids), list(r.b_ids)) for r in rows if r.doc_id == 1] == [tuple(g) for g in walked("ünïcode text", a, b)]
    assert {r.doc_id for r in rows} == {1, 3}


def test_empty_table(spark):
    assert T.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_query_returns_all_documents(spark):
    from quern.llm.queries import op13_pointer_alignment

    rows = op13_pointer_alignment(spark, DATA)
    assert rows.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert set(rows.columns) == {"doc_id", *FIELDS}


def test_parts_bound_a_workers_memory(texts, monkeypatch):
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(T, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    some = [*HARD, *(texts[i] for i in sorted(texts))]
    some = some * (4_000_000 // sum(len((t or "").encode()) for t in some) + 1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(some)), pa.int64()), pa.array(some, pa.string())], names=["doc_id", "_text"])
    list(T._aligning(A, B)(iter([batch.slice(0, 1)])))  # the vocabularies are loaded
    tracemalloc.start()
    try:
        for _ in T._aligning(A, B)(iter([batch])):
            pass
        assert tracemalloc.get_traced_memory()[1] < 130e6  # 295 MB when a block was aligned at once
    finally:
        tracemalloc.stop()


def test_remembered_units_are_bounded_and_equal(monkeypatch):
    _, b = T.load(A, B)
    monkeypatch.setattr(T, "REMEMBERED", 8)
    units = T.Units(b.model, b.bytes)
    names = [f" w{i % 3}" if i % 2 else f" z{i}" for i in range(60)]
    assert all(np.frombuffer(units[u], np.int32).tolist() == b.model.encode("\n" + u)[2:] for u in names)
    assert len(units) + len(units.older) <= 8
