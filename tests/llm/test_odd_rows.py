"""Defined results for nulls, empty and long texts, repeated rows, ties, empty tables and clashing column names."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import avi_media, bpe_count, chat_parts, curriculum, license_scan, mil_quality, packing, quality_llr, secrets, token_join
from quern.llm.words import n_words

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def sizes(docs):
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def labels(spark):
    return spark.createDataFrame([(4, 1), (6, 0), (9, 0), (5, None), (None, 1), (77, 1)], "doc_id long, quality int")


def chat(docs):
    """Rows of documents as turns: source is the conversation, n_chars the turn, lang the role."""
    turns = docs.select(F.crc32(F.coalesce("source", F.lit(""))).alias("conv_id"), F.col("n_chars").alias("turn"), F.col("lang").alias("role"), chat_parts.text_parts(F.col("text")).alias("parts"), "doc_id")
    return chat_parts.digest(chat_parts.format_turns(turns))


OPERATORS = {
    "chat": lambda spark, d: chat(d),
    "quality_llr": lambda spark, d: quality_llr.quality_rules(d, spark.createDataFrame([(4,), (None,)], "doc_id long")),
    "avi": lambda spark, d: avi_media.read_back(avi_media.store(d, "text")),
    "clips": lambda spark, d: avi_media.clips(avi_media.store(d, "text")),
    "secrets": lambda spark, d: secrets.digest(secrets.scan(d)),
    "token_join": lambda spark, d: token_join.jaccard_components(d),
    "bpe": lambda spark, d: bpe_count.bpe_counts(d, PIECES),
    "license": lambda spark, d: license_scan.license_scan(d),
    "mil": lambda spark, d: mil_quality.score(d, mil_quality.train(d, labels(spark))),
    "packing": lambda spark, d: packing.pack(packing.token_pieces(d, WORDS)),
    "curriculum": lambda spark, d: curriculum.curriculum_mix(sizes(d)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table_gives_no_rows(spark, empty, name):
    assert OPERATORS[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"clips", "packing", "chat"}))
def test_every_row_gets_a_row(spark, odd, name):
    rows = OPERATORS[name](spark, odd).collect()
    assert len(rows) == 11 and sorted(str(r.doc_id) for r in rows) == sorted(map(str, [1, None, 2, 3, 4, 4, 5, 6, 7, 8, 9]))


def by_id(rows):
    return {r.doc_id: r for r in rows.collect()}


def test_chat_of_odd_rows(spark, odd):
    rows = chat(odd).collect()
    assert sum(r.n_turns for r in rows) == 11 and len(rows) == 4  # nulls and the empty source are one conversation here


def test_token_join_of_odd_rows(spark, odd):
    rows = by_id(token_join.jaccard_components(odd))
    assert (rows[1].n_shingles, rows[1].component_id, rows[2].component_id, rows[3].n_shingles) == (0, 1, 2, 0)
    assert rows[5].component_id == 4 and rows[7].component_id == 6 and rows[6].n_shingles == 1 and rows[9].n_shingles == 1


def test_quality_of_empty_text(spark, odd):
    rows = by_id(OPERATORS["quality_llr"](spark, odd))
    assert rows[1].base_failed and not rows[1].kept and rows[1].llr == 0.0 and rows[9].n_repeat_words == 30000


def test_avi_of_empty_text_and_foreign_bytes(spark, odd):
    rows = by_id(OPERATORS["avi"](spark, odd))
    assert rows[1].payload_bytes == 64 and rows[1].payload_sha256 == rows[2].payload_sha256
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"RIFFxxxx")), (3, bytearray())], "doc_id long, media binary")
    assert avi_media.clips(broken).count() == 0


def test_avi_decodes_symbol_by_symbol_alike():
    import numpy as np

    payload = np.random.default_rng(0).integers(0, 256, 5000, dtype=np.uint8).tobytes()
    frames, _, length = avi_media.parse(avi_media.encode(payload))
    fast = avi_media.decode(frames)
    slow = [avi_media._levels(j, avi_media._by_symbol(j, f)).ravel() for f in frames if (j := avi_media.Jpeg(f))]
    assert length == 5000 and (np.stack(fast) == np.stack(slow)).all() and b"".join(x.tobytes() for x in fast)[:5000] == payload


def test_shots_cut_where_the_picture_changes():
    import numpy as np

    dark, light = np.full((10, 64), 20, np.uint8), np.full((6, 64), 220, np.uint8)
    assert [(a, b) for a, b, _ in avi_media.shots(np.concatenate([dark, light]))] == [(0, 10), (10, 16)]


def test_random_runs_are_found_and_prose_is_not(spark):
    key = "kZ8vQ2mX7pL4tR9wB3nY6cH1sD5fG0jKaE"
    rows = spark.createDataFrame([(1, f"see {key} there"), (2, "incomprehensibilities1 antidisestablishment2arian"), (3, "1234567890123456789012345")], "doc_id long, text string")
    found = by_id(secrets.digest(secrets.scan(rows)))
    assert found[1].spans == f"random:4:{4 + len(key)}" and found[2].spans == "" and found[3].spans == "hex:0:25"
    assert secrets.masked("ab SECRET cd", [(3, 0, 9), (5, 2, 8)]) == "ab [SECRET] cd"


def test_licenses_with_inserted_words_are_one_band(spark):
    text = "Permission is hereby granted, free of charge, to any lucky person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without any restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    row = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == "mit" and row.n_base == 0 and 0.75 <= row.score <= 1


def test_packing_places_all_pieces_once(spark, odd):
    rows = packing.pack(packing.token_pieces(odd, WORDS)).collect()
    assert sum(r.doc_id == 9 for r in rows) == 30001 // 2048 + 1 and sum(r.doc_id == 4 for r in rows) == 2
    spots = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for a, b in zip(spots, spots[1:]):
        assert (b[1] == a[1] + a[2]) if a[0] == b[0] else b[1] == 0


@pytest.mark.parametrize("histogram", [{}, {2048: 5}, {1: 7}, {1500: 40, 548: 39, 3: 100}, {n: n % 7 + 1 for n in range(1, 2049)}])
def test_plan_covers_every_rank(histogram):
    room = {}
    for length, first, end, sequence, offset in packing.plan(histogram):
        for k in range(end - first):
            room.setdefault(sequence + k, []).append((offset, length))
        assert 0 <= first < end <= histogram[length]
    total = sum(n * c for n, c in histogram.items())
    assert sum(n for p in room.values() for _, n in p) == total
    for p in room.values():
        p.sort()
        assert all(o == sum(n for _, n in p[:i]) for i, (o, _) in enumerate(p)) and sum(n for _, n in p) <= 2048


def test_targets_are_filled_by_weight_up_to_the_cap(spark):
    rows = [(i, s, n) for i, (s, n) in enumerate([("a", 10), ("a", 10), ("b", 400), ("c", 100), (None, 50)])]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = {r.source: r.target for r in curriculum.source_targets(sizes).collect()}
    weights, caps, total = {"a": 5, "b": 2, "c": 1, None: 5}, {"a": 60, "b": 1200, "c": 300, None: 150}, 570
    free, want = set(weights), {}
    while True:
        left = total - sum(caps[s] for s in want)
        share = {s: left * weights[s] / sum(weights[t] for t in free) for s in free}
        over = {s for s in free if share[s] > caps[s]}
        if not over:
            want |= share
            break
        want |= {s: caps[s] for s in over}
        free -= over
    assert got == pytest.approx(want)


def test_parts_become_placeholders_and_texts_come_back(spark):
    part = lambda kind, **more: {"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | more
    tricky = "a [ROLE] <s> \\ </s>\n<image 0.0> [/ROLE]"
    rows = spark.createDataFrame(
        [(1, 0, "user", [part("text", text=tricky), part("image", ref="x.png", width=28, height=15), part("audio", ref="y", seconds=1.5)]), (1, 1, "assistant", [part("text", text="ok"), part("document", ref="z", pages=2)]), (1, 2, None, None), (None, None, "user", [])],
        f"conv_id long, turn long, role string, parts {chat_parts.PARTS_TYPE}",
    )
    turns = chat_parts.format_turns(rows).orderBy("conv_id", "pos").collect()
    first = turns[1]
    assert [(a.kind, a.at, a.ref, a.tokens) for a in first.attachments] == [("image", "0.1", "x.png", 4), ("audio", "0.2", "y", 38)] and first.expanded_tokens == 42
    match = chat_parts.TURN.fullmatch(first.segment)
    assert chat_parts.unescape(match[2]) == f"{tricky}<image 0.1><audio 0.2>"
    assert turns[2].expanded_tokens == 512 and turns[3].role == "" and len(turns) == 4
    assert chat_parts.digest(chat_parts.format_turns(rows)).count() == 2


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 300), st.integers(0, 80), st.integers(0, 80), st.integers(0, 2**32))
def test_bitmaps_differ_in_no_more_bits_than_sets(same, left, right, seed):
    tokens = np.random.default_rng(seed).choice(2**40, same + left + right, replace=False).astype(np.uint64)
    a, b = token_join.parity(tokens[: same + left]), token_join.parity(np.concatenate([tokens[:same], tokens[same + left :]]))
    size = min(len(a), len(b))
    fold = lambda bits: np.bitwise_xor.reduce(bits.reshape(-1, size))
    assert np.bitwise_count((fold(a) ^ fold(b)).view(np.uint64)).sum() <= left + right


def test_parity_filter_keeps_every_similar_pair(spark):
    rng, sets = np.random.default_rng(5), []
    for n in (1, 3, 63, 65, 120, 130, 700):
        base = rng.choice(2**40, n + n // 3, replace=False)
        sets += [sorted(base[:n].tolist()), sorted(base.tolist()), sorted(base[n // 8 : n + n // 8].tolist()), sorted(rng.choice(2**40, n, replace=False).tolist())]
    rows = [(i, len(s), s, token_join.parity(np.array(s, np.uint64)).tolist()) for i, s in enumerate(sets)]
    whole = spark.createDataFrame(rows, "rid long, n long, tokens array<long>, bits array<long>")
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b]))]
    similar = {(a, b) for a, b in pairs if 7 * len(set(sets[a]) & set(sets[b])) >= 3 * (len(sets[a]) + len(sets[b]))}
    near = {tuple(r) for r in token_join.near_by_parity(spark.createDataFrame(pairs, "a long, b long"), whole).collect()}
    assert similar <= near and len(similar) >= 10 and len(near) < len(pairs)


def test_components_agree_when_too_many_rows_for_a_broadcast(spark, odd, monkeypatch):
    some = sorted(map(str, token_join.jaccard_components(odd).collect()))
    monkeypatch.setattr(token_join, "MOST_BROADCAST", 0)
    assert sorted(map(str, token_join.jaccard_components(odd).collect())) == some
