"""The prefix theorem behind the signatures of the n-gram Jaccard join."""

import numpy as np
import pytest

from quern.llm import token_join


def pairs(rng, number):
    """Sets of tokens, the second similar enough to the first."""
    for _ in range(number):
        n = int(rng.integers(1, 400))
        same = int(rng.integers(token_join.required(n), n + 1))
        most = 100 * same // token_join.PERCENT - n  # tokens of the other's own, so that the union is small enough
        tokens = rng.choice(2**60, n + max(most, 0), replace=False).astype(np.uint64)
        other = np.concatenate([tokens[:same], tokens[n : n + int(rng.integers(0, max(most, 0) + 1))]])
        if 100 * same >= token_join.PERCENT * (n + len(other) - same):
            yield np.sort(tokens[:n]), np.sort(other)


@pytest.mark.parametrize("frequent", [0.0, 0.5, 0.9, 1.0])
def test_similar_sets_have_a_signature_in_common(frequent):
    rng, tried = np.random.default_rng(int(10 * frequent)), 0
    for a, b in pairs(rng, 1500):
        every = np.unique(np.concatenate([a, b]))
        common = dict(zip(every.tolist(), np.where(rng.random(len(every)) < frequent, 1000, 2).tolist()))
        both = set(a.tolist()) & set(b.tolist())

        def signed(s):
            head = [t for t in s[: token_join.extended_prefix(len(s))].tolist() if t in both]  # tokens of one set only are left out
            return set(token_join.signatures(len(s), np.array(head, np.int64), np.array([common[t] for t in head]), token_join.FREQUENT).tolist())

        assert signed(a) & signed(b)
        tried += 1
    assert tried > 800


def test_followers_dealt_over_many_tasks_find_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = [f"w{n}" for n in range(60)]
    rows = []
    for i in range(160):  # variants of one text, some of which link only with each other
        words = list(base)
        for at in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            words[at] = f"x{rng.integers(0, 6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    some = sorted(map(tuple, token_join.jaccard_components(docs).collect()))
    monkeypatch.setattr(token_join, "FOLLOWERS", 5)
    monkeypatch.setattr(token_join, "FREQUENT", 3)
    assert sorted(map(tuple, token_join.jaccard_components(docs).collect())) == some
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} for i, t in rows}
    part = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = part[a], part[b]
                part = {i: min(x, y) if p in (x, y) else p for i, p in part.items()}
    assert [(i, c) for i, _, c in some] == sorted(part.items())
