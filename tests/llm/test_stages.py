"""The stages of the corpus pipeline on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import os

import corpus_pipeline
import pytest

from quern.llm import packing
from quern.llm.words import n_words

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A data folder whose labels are those of the odd rows."""
    where = str(tmp_path_factory.mktemp("sf"))
    labels = [(4, 1), (5, 1), (6, 0), (9, 0), (8, None), (None, 1), (77, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(os.path.join(where, "labels.parquet"))
    return where


@pytest.fixture(scope="module")
def no_labels(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, None)], "doc_id long, quality int").write.parquet(os.path.join(where, "labels.parquet"))
    return where


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_empty_table_gives_no_rows(spark, empty, folder, name, stage):
    out = stage(spark, empty, folder)
    assert out.count() == 0 and (name == "pack" or out.columns == COLUMNS)


def test_quality_judges_copies_alike_and_keeps_all_without_labels(spark, odd, folder, no_labels):
    kept = corpus_pipeline.quality(spark, odd, folder)
    rows = kept.collect()
    assert kept.columns == COLUMNS and sum(r.doc_id == 4 for r in rows) in (0, 2)
    assert sorted(map(str, (r.doc_id for r in corpus_pipeline.quality(spark, odd, no_labels).collect()))) == sorted(map(str, (r.doc_id for r in odd.collect())))


def test_one_row_of_a_group_stays(spark, odd, folder):
    kept = corpus_pipeline.near_duplicates(spark, odd, folder)
    assert kept.columns == COLUMNS
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, None, 2, 3, 4, 6, 8, 9]))


def test_secrets_are_masked_and_rows_stay(spark, odd, folder):
    extra = spark.createDataFrame([(20, "password = abcdefghij123456", "en", "s", 3), (21, None, None, None, None)], odd.select(*COLUMNS).schema)
    rows = {r.doc_id: r for r in corpus_pipeline.mask_secrets(spark, odd.select(*COLUMNS).union(extra), folder).collect()}
    assert rows[20].text == "[SECRET]" and rows[20].n_chars == 8 and rows[21].text is None and rows[21].n_chars is None
    assert rows[9].n_chars == 150_000 and rows[2].text == ""


def test_each_copy_has_its_own_place_in_the_mix(spark, odd, folder):
    mixed = corpus_pipeline.mix_sources(spark, odd, folder)
    taken = sum(len((r.text or "").split()) for r in mixed.collect())
    total = sum(r[0] for r in odd.select(n_words("text")).collect())
    assert mixed.columns == COLUMNS and taken == pytest.approx(total, abs=10)
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts[4] <= 2 * 4 and counts[9] <= 4 and not {1, 2, 3} & set(counts)  # rows without words have nothing to take


def test_every_row_is_packed(spark, odd, folder):
    rows = corpus_pipeline.pack_sequences(spark, odd, folder).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()} and max(r.offset + r.length for r in rows) <= 2048


def test_rows_are_told_apart_by_values_nulls_and_lengths(spark):
    rows = [("a\nb", "c"), ("a", "b\nc"), (None, "c"), ("", "c"), ("-", "c"), ("a\nb", "c")]
    keys = [r[0] for r in spark.createDataFrame(rows, "x string, y string").select(corpus_pipeline.row_key("x", "y")).collect()]
    assert len(set(keys)) == 5 and keys[0] == keys[5]


def test_sequences_keep_the_order_of_the_mix(spark, folder, tmp_path, monkeypatch):
    """Sources of negative tilt come early in training, those of positive tilt late; so do their sequences."""
    monkeypatch.setattr(packing, "IN_WINDOW", 200)
    rows = [(i, f"word{i % 7} " * (40 + i % 300), "en", "abc"[i % 3], 1) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path / "mix")
    corpus_pipeline.mix_sources(spark, docs, folder).write.parquet(path)
    mixed = spark.read.parquet(path)
    placed = corpus_pipeline.pack_sequences(spark, mixed, folder).collect()
    order = {}
    for r in placed:
        order.setdefault(r.sequence_id, len(order))
    assert [r.position for r in placed] == sorted(r.position for r in placed)
    ranks = {}
    for r in placed:
        ranks.setdefault("abc"[r.doc_id % 3], []).append(order[r.sequence_id] / len(order))
    mean = {k: sum(v) / len(v) for k, v in ranks.items()}
    assert mean["a"] < mean["b"] < mean["c"] and mean["c"] - mean["a"] > 0.1  # tilts -0.5, 0 and 0.5
    room = {}
    for r in placed:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in room.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0


def test_order_of_rows_read_and_of_rows_made(spark, tmp_path):
    import corpus_pipeline

    made = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "doc_id long, text string").coalesce(1)
    made.write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    assert {r.doc_id: r._position for r in corpus_pipeline.in_written_order(read).collect()} == {i: i for i in range(6)}
    for other in (made, read.groupBy("doc_id").agg({"text": "max"})):  # the latter comes of files, but its rows do not say where they stood
        assert [r._position for r in corpus_pipeline.in_written_order(other).collect()] == [0] * 6
