"""Operators of whole texts: nothing of a text is left out."""

import numpy as np
import pytest

from quern.llm import mil_quality, secrets

KEY = "kZ8vQ2mX7pL4tR9wB3nY6cH1sD5fG0jKaE"


@pytest.mark.parametrize("before, after", [("AWS_SECRET_ACCESS_KEY=", ""), ("see https://host.example/a?sig=", "&x=1"), ("?sig==", " "), ("id: ", "=value"), ("id: ", "===")])
def test_a_key_beside_an_equals_sign_is_found_and_masked(spark, before, after):
    rows = spark.createDataFrame([(1, f"{before}{KEY}{after}"), (2, "plain words")], "doc_id long, text string")
    found = {r.doc_id: r for r in secrets.scan(rows).collect()}
    assert [s.start for s in found[1]._spans if s.kind == "random"] == [len(before)] and KEY not in found[1]._masked
    assert found[1]._masked.startswith(f"{before}[SECRET]") and found[2]._spans == []


def test_padding_belongs_to_the_key():
    assert [m[0] for m in secrets.CANDIDATE.finditer(f"a={KEY}== b={KEY}=, {KEY}")] == [KEY + "==", KEY + "=", KEY]


def bags(spark):
    texts = [(i, ("fine words of plain prose. " * 40 * (i % 5 + 1)) + ("#$%& 00 " * 60 if i % 2 else ""), i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    return texts, docs, spark.createDataFrame([(i, q) for i, _, q in texts], "doc_id long, quality int")


def test_training_sees_every_passage(spark, monkeypatch):
    texts, docs, labels = bags(spark)
    kept = {r.doc_id for r in labels.filter(~mil_quality.held_out(labels.doc_id)).collect()}
    seen = []
    monkeypatch.setattr(mil_quality.GatedAttention, "fit", classmethod(lambda cls, x, text, y: seen.append(np.bincount(text))))
    mil_quality.train(docs, labels)
    want = sorted(-(-len(t) // mil_quality.PASSAGE) for i, t, _ in texts if i in kept)
    assert sorted(seen[0].tolist()) == want and max(want) > 8


def test_training_by_tasks_gives_the_same_network(spark, monkeypatch):
    _, docs, labels = bags(spark)
    monkeypatch.setattr(mil_quality, "STEPS", 6)
    held = mil_quality.train(docs, labels)
    monkeypatch.setattr(mil_quality, "MOST_HELD", 0)
    spread = mil_quality.train(docs, labels)
    assert all(np.allclose(held.w[k], spread.w[k], rtol=1e-6, atol=1e-9) for k in held.w)
