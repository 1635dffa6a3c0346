"""Each numbered query on its whole small table, against a plain computation or SQL."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

from quern.llm import license_scan, mil_quality, quality_llr, secrets
from quern.llm.queries import ORACLE_SQL, QUERIES

from .conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, name):
    found = QUERIES[name](spark, DATA).collect()
    return found


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    theirs = con.sql(ORACLE_SQL[name])
    columns = sorted(theirs.columns)
    want = sorted((tuple(r[theirs.columns.index(c)] for c in columns) for r in theirs.fetchall()), key=str)
    got = sorted((tuple(r[c] for c in columns) for r in rows_of(spark, name)), key=str)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b) if all(isinstance(v, (int, float)) for v in a) else a == b


def test_op1_base_counts_and_ratios(spark, texts):
    token = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+")
    trusted = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").collect()}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    long = lambda v, seed: xxhash.xxh64(struct.pack("<q", v), seed=seed & (1 << 64) - 1).intdigest()
    grams = {}
    for i, t in texts.items():
        h = [signed(xxhash.xxh64(x.encode(), seed=42).intdigest()) for x in token.findall(t)]
        grams[i] = [x % quality_llr.BUCKETS for x in h] + [signed(long(b, long(a, 42))) % quality_llr.BUCKETS for a, b in zip(h, h[1:])]
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        target.update(g if i in trusted else [])
    share = lambda c, b: (c[b] + 1.0) / (sum(c.values()) + quality_llr.BUCKETS)
    table = {b: np.log(share(target, b) / share(raw, b)) for b in set(raw)}
    for r in rows_of(spark, "op1_quality_llr"):
        t = texts[r.doc_id]
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {k + d for k, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for d in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)
        llr = sum(table[b] for b in grams[r.doc_id]) / len(grams[r.doc_id])
        assert r.llr == pytest.approx(llr) and r.kept == (not failed and llr >= quality_llr.THRESHOLD)


def test_op2_payload_comes_back(spark, texts):
    for r in rows_of(spark, "op2_avi_media"):
        raw = texts[r.doc_id].encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_op3_spans_match_plain_patterns(spark, texts):
    plain = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    total = 0
    for r in rows_of(spark, "op3_random_secrets"):
        t = texts[r.doc_id]
        spans = [(m.start(), 0, m.end()) for m in plain.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert r.base_sha256 == secrets.digest_of(sorted(spans))
        assert {f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans} <= set(filter(None, r.spans.split(",")))
        total += len(spans)
    assert total


def test_op5_counts_are_the_librarys(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows_of(spark, "op5_bpe_count"):
        n = len(model.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 4096)


def test_op6_places_match_a_plain_scan(spark, texts):
    for r in rows_of(spark, "op6_license_diagonals"):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id])
        w = re.findall(license_scan.WORD, t)
        places = [(k, label) for phrase, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        own = set()  # a template whose words stand in the text as they are is always found
        for label, text in license_scan.TEMPLATES:
            p = license_scan.template_words(text)
            own |= {label} if any(w[k : k + len(p)] == p for k in range(len(w))) else set()
        assert own | {label for _, label in places} <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_op7_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [r for r in rows_of(spark, "op7_attention_quality") if r.doc_id in labels and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert len(rows) > 10 and np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.9


def test_op8_sequences_hold_every_piece(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows, sequences = defaultdict(list), defaultdict(list)
    for r in rows_of(spark, "op8_linear_grouping"):
        rows[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t in texts.items():
        ids = np.asarray(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4")
        want = [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows[i]) == want
    for placed in sequences.values():
        placed.sort()
        assert [o for o, _ in placed] == [sum(n for _, n in placed[:k]) for k in range(len(placed))] and sum(n for _, n in placed) <= 2048
    total = sum(n for p in sequences.values() for _, n in p)
    assert len(sequences) <= 1.02 * -(-total // 2048) + 2


def test_op9_shares_and_bounds(spark):
    rows = rows_of(spark, "op9_curriculum_mix")
    assert sum(r.taken for r in rows) == pytest.approx(sum(r.size for r in rows), rel=1e-3)
    assert all(r.taken <= 3 * r.size for r in rows)
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    taken, target = Counter(), {}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        assert target.setdefault(source[r.doc_id], r.target) == r.target
    assert all(abs(target[s] - taken[s]) <= 1 for s in target) and len(target) > 1
    assert [r.position for r in rows if r.position is not None] == sorted(r.position for r in rows if r.position is not None)


def test_pipeline_stages_agree_with_plain_checks(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, DATA)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    once = corpus_pipeline.near_duplicates(spark, good, DATA).cache()
    sets = {}
    for r in once.collect():
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    index = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            index[g].append(i)
    pairs = Counter((a, b) for own in index.values() for a in own for b in own if a < b)
    assert not [p for p, k in pairs.items() if 100 * k >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - k)]
    masked = corpus_pipeline.mask_secrets(spark, once, DATA)
    assert masked.count() == once.count() and not [r for r in masked.collect() if secrets.base_spans(r.text)]
    mixed = corpus_pipeline.mix_sources(spark, masked, DATA)
    assert mixed.columns == docs.columns
    packed = corpus_pipeline.pack_sequences(spark, mixed, DATA)
    assert packed.count() >= mixed.count() and packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_training_needs_both_classes_or_says_so():
    x, text = np.zeros((3, mil_quality.FEATURES)), np.array([0, 1, 2])
    net = mil_quality.GatedAttention.fit(x, text, np.array([1, 1, 1]))
    assert np.allclose(net.scores(x, text, 3), 1.0)
