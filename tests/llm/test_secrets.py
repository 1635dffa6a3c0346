"""Randomness battery, discovery control and spans of secret scans against plain computations."""

import math
import random

import numpy as np
import pytest

from quern.llm import secrets

BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def keys(rng, n, alphabet=BASE62, length=(24, 48)):
    return ["".join(rng.choices(alphabet, k=rng.randint(*length))) for _ in range(n)]


def prose(rng, n):
    """Runs of letters drawn as in prose, with a capital inside so that they are candidates."""
    letters, weights = zip(*secrets.LETTERS.items())
    out = []
    for _ in range(n):
        word = "".join(rng.choices(letters, weights, k=rng.randint(22, 40)))
        out.append(word[:9] + word[9].upper() + word[10:15] + word[15].upper() + word[16:])
    return out


def step_up(p_values, fdr):
    """The largest p-value that Benjamini and Hochberg reject, or -1."""
    ordered = sorted(p_values)
    return max((p for i, p in enumerate(ordered, 1) if p <= fdr * i / len(ordered)), default=-1.0)


def found_plainly(texts):
    """Random spans of texts by the definition, p-values rounded as stated."""
    rows = [(n, c) for n, t in enumerate(texts) for c in secrets.candidates(t)]
    mean = sum(c.end - c.start for _, c in rows) / len(rows)
    rounded = lambda c, decades: 10 ** (-max(0, math.floor(20 * (decades + math.log10((c.end - c.start) / mean)))) / 20)
    odd = [rounded(c, c.odd) for _, c in rows]
    odd_limit = step_up(odd, secrets.RANDOM_FDR)
    language = [1.0 if o <= odd_limit else rounded(c, c.decades) for o, (_, c) in zip(odd, rows)]
    limit = step_up(language, secrets.FDR)
    return {(n, c.start, c.end) for p, (n, c) in zip(language, rows) if p <= limit}


def corpus(seed):
    rng = random.Random(seed)
    return [f"some {k} words" for k in keys(rng, 30)] + [f"NAME={k}\n" for k in keys(rng, 10)] + [f"and {w} too" for w in prose(rng, 300)] + [f"x {'Ab1' * 9} y {'aB' * 15}"] * 5


@pytest.mark.parametrize("seed", [1, 2])
def test_found_spans_are_those_of_two_plain_step_ups(spark, seed):
    texts = corpus(seed)
    want = found_plainly(texts)
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {(r.doc_id, s["start"], s["end"]) for r in rows for s in r["_spans"] if s["kind"] == "random"}
    assert got <= want and len(want) > 25
    assert all(any(n == m and a <= s and e <= b for m, a, b in got) for n, s, e in want)  # others lie inside a found one
    truly = {n for n in range(40)}
    assert len([n for n, _, _ in got if n not in truly]) <= 1  # far below a thousandth of what is found, on average


def test_p_values_of_random_strings_are_valid():
    rng = np.random.default_rng(5)
    for n, k in ((20, 62), (40, 16), (200, 64)):
        p = np.array([secrets.battery(v.tolist(), k) for v in rng.integers(0, k, (2000, n))])
        for at in (0.01, 0.05, 0.2, 0.5):
            assert ((p <= at).mean(axis=0) <= at + 4 * math.sqrt(at / 2000) + 0.02).all()


def test_p_values_fall_as_strings_grow_less_uniform():
    for n in (60, 300):
        p = [secrets.battery([0] * m + [(7 * i + i * i) % 62 for i in range(n - m)], 62)[0] for m in (0, 4, 8, 16, 32)]
        assert p == sorted(p, reverse=True) and p[-1] < 0.001


def test_keys_after_names_in_queries_and_in_paths(spark):
    key = "kZ8vQ2mX7pL4tR9wB3nY6cH1sD5fG0jKaE"
    texts = [f"AUTH={key}\n", f"/x?sig={key}&a=1", f"/home/user/{key}/x", f'"{key}"']
    rows = secrets.digest(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    for r in rows:
        at = texts[r.doc_id].index(key)
        spans = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",")]
        assert any(a <= at and at + len(key) <= b for a, b in spans), texts[r.doc_id]
