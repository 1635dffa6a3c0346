"""Secret scans with a battery of randomness tests.

Three fixed patterns find assigned, access-key and hexadecimal secrets. Beside them, every run of 20 or more key
characters that mixes digits or cases is a candidate, and so is such a stretch between slashes in it. Its encoding is
inferred from its characters, and three tests ask whether it looks uniformly random in that encoding: chi-squared of the
symbol counts, Wald-Wolfowitz runs above and below the middle of the alphabet, and lag-1 serial correlation. Their
p-values come from simulated tails of the same length and alphabet up to SIMULATED characters, and from a gamma and two
normal distributions beyond it; the least of them, times three, is the battery's.

Discovery is controlled over the whole corpus, in two step-ups of Benjamini and Hochberg over all candidates. The first
takes the battery's p-values: at RANDOM_FDR, what it rejects is not random. The second asks whether a candidate is written
language: the likelihood of its characters under a table of letter frequencies, divided by that under its encoding, is
a valid p-value (Markov's inequality) that shrinks with length; what the first step rejected stays in this family with
p-value 1. A candidate that the first does not reject and the second does, at FDR, is found. Both weigh p-values by
length (mean weight 1) and count them in bins of a twentieth of a decade, rounded against rejection.

Defined results: null text is empty and has no spans. Spans are code points, end exclusive. A random span inside another
one is left out. Repeated rows each get their spans; candidates of repeated rows each count. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import discard, staged

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: What every match of ASSIGN holds, in lower case.
_NAMES = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: A whole run; '=' is no key character, so a run may follow one, and only two behind it count, as padding, where the key ends.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
LEAST_KEY = 20
#: Share of random keys among candidates discarded as not random, and of language among those found, at most.
RANDOM_FDR, FDR = 0.01, 0.001
#: Up to this length the battery's tails are simulated, with so many draws.
SIMULATED, DRAWS = 128, 9999
#: Letter frequencies of Western European prose, in per mille; others get the last value.
LETTERS = {"a": 75, "b": 14, "c": 30, "d": 42, "e": 140, "f": 15, "g": 18, "h": 35, "i": 72, "j": 3, "k": 7, "l": 42, "m": 27, "n": 78, "o": 60, "p": 24, "q": 5, "r": 66, "s": 68, "t": 70, "u": 44, "v": 12, "w": 12, "x": 3, "y": 10, "z": 7}
CAPITAL, DIGIT, OTHER = 1.2, 2.0, 2.0
BINS_A_DECADE, MOST_BINS = 20, 6000

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from narrow to wide; the first whose alphabet holds a candidate is inferred.
ENCODINGS = (
    ("hex", _DIGITS + "abcdef"), ("hex", _DIGITS + "ABCDEF"), ("base32", _UPPER + "234567"), ("base36", _DIGITS + _LOWER),
    ("base36", _DIGITS + _UPPER), ("base62", _DIGITS + _UPPER + _LOWER), ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
)
_ALPHABETS = [(name, {c: i for i, c in enumerate(alphabet)}) for name, alphabet in ENCODINGS]
_PROSE = {c: math.log(v / 1000) for c, v in LETTERS.items()} | {c: math.log(CAPITAL / 1000) for c in _UPPER} | {c: math.log(DIGIT / 1000) for c in _DIGITS}


def inferred(token: str) -> tuple[str, dict[str, int]] | None:
    """The narrowest encoding that holds a token; None where it is no candidate: digits only, or words only."""
    body = token.rstrip("=")
    has_digit = any(c in _DIGITS for c in body)
    if body.isdigit() or not (has_digit or re.search(r"[a-z][A-Z].*[A-Z][a-z]", body)):
        return None
    if not any(c.isalpha() for c in body):
        return None
    return next(((n, a) for n, a in _ALPHABETS if all(c in a for c in body)), None)


def statistics(values: np.ndarray, k: int) -> np.ndarray:
    """Chi-squared, distance of runs and distance of serial correlation of rows of symbols 0..k-1: (rows, 3)."""
    rows, n = values.shape
    place = values + k * np.arange(rows)[:, None]
    counts = np.bincount(place.ravel(), minlength=rows * k).reshape(rows, k).astype(float)
    chi = (counts * counts).sum(axis=1) * k / n - n
    high = values >= k // 2
    a = high.sum(axis=1).astype(float)
    both = 2 * a * (n - a)
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    spread = np.sqrt(np.maximum(both * (both - n) / (n * n * (n - 1.0)), 1e-9))
    of_runs = np.abs(runs - 1 - both / n) / spread
    off = values - values.mean(axis=1, keepdims=True)
    power = (off * off).sum(axis=1)
    serial = np.where(power > 0, np.abs((off[:, 1:] * off[:, :-1]).sum(axis=1) / np.where(power > 0, power, 1) + 1 / n), np.inf)
    return np.stack([chi, of_runs, serial], axis=1)


@lru_cache(4096)
def _simulated(n: int, k: int) -> np.ndarray:
    """The statistics of DRAWS uniform strings, each sorted: (3, DRAWS). The same for every worker."""
    rng = np.random.default_rng([n, k])
    return np.sort(np.concatenate([statistics(rng.integers(0, k, (1111, n)), k) for _ in range(DRAWS // 1111)]), axis=0).T.copy()


def battery(values: list[int], k: int) -> tuple[float, float, float]:
    """P-values of chi-squared uniformity, runs and serial correlation for symbols 0..k-1."""
    n = len(values)
    found = statistics(np.asarray([values]), k)[0]
    if n <= SIMULATED:
        tails = _simulated(n, k)
        uniform, of_runs, serial = (float(1 + DRAWS - np.searchsorted(t, x - 1e-9)) / (DRAWS + 1) for t, x in zip(tails, found))
        return uniform, of_runs, serial
    mean, variance = k - 1, 2 * (k - 1) * (n - 1) / n
    shape = mean * mean / variance  # a gamma distribution with these moments, by its cube root
    z = ((found[0] / mean) ** (1 / 3) - (1 - 1 / (9 * shape))) * 3 * math.sqrt(shape)
    return 0.5 * math.erfc(z / math.sqrt(2)), math.erfc(found[1] / math.sqrt(2)), math.erfc(found[2] * math.sqrt(n) / math.sqrt(2))


class Candidate(NamedTuple):
    """A run that may be a key; p-values in decades, -log10: that it is random, and that it is language."""

    start: int
    end: int
    odd: float
    decades: float


def _judged(token: str, start: int) -> Candidate | None:
    known = inferred(token)
    if known is None:
        return None
    alphabet, body = known[1], token.rstrip("=")
    odd = min(1.0, 3 * min(battery([alphabet[c] for c in body], len(alphabet))))
    evidence = -sum(_PROSE.get(c, math.log(OTHER / 1000)) for c in body) - len(body) * math.log(len(alphabet))
    return Candidate(start, start + len(token), -math.log10(max(odd, 1e-300)), max(0.0, evidence / math.log(10)))


def candidates(text: str) -> list[Candidate]:
    """The runs that may be keys, and the stretches between slashes of those that hold any."""
    out = []
    for m in CANDIDATE.finditer(text):
        parts = [(m.start(), m[0])]
        if "/" in m[0]:
            parts += [(m.start() + p.start(), p[0]) for p in re.finditer("[^/]+", m[0]) if len(p[0].rstrip("=")) >= LEAST_KEY]
        out += [c for at, token in parts if (c := _judged(token, at))]
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    spans = []
    folded = text.lower()
    if any(name in folded for name in _NAMES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def weighted_decades(length: int, decades: float, mean_length: float) -> int:
    """The bin of a p-value after its weight, length by mean length."""
    return min(MOST_BINS, max(0, int(BINS_A_DECADE * (decades + math.log10(length / mean_length)))))


class Limits(NamedTuple):
    """Mean candidate length, least bin that is not random, least bin that is no language."""

    mean_length: float
    odd: int
    least: int


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("length", pa.int64()), ("odd", pa.float64()), ("decades", pa.float64())])
    for batch in batches:
        rows = [(c.end - c.start, c.odd, c.decades) for text in batch.column("_text") for c in candidates(text.as_py())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _step_up(family: DataFrame, bins: Column, fdr: float) -> int:
    """The least bin that the Benjamini-Hochberg step-up over all rows rejects; one past the last where it rejects none."""
    counts = family.groupBy(bins.alias("bin")).agg(F.count("*").alias("n"))
    down = Window.orderBy(F.desc("bin"))  # at most MOST_BINS rows
    steps = counts.select("bin", F.sum("n").over(down).alias("reached"), F.sum("n").over(Window.partitionBy()).alias("all"))
    passing = F.pow(F.lit(10.0), -F.col("bin") / BINS_A_DECADE) <= fdr * F.col("reached") / F.col("all")
    least = steps.filter(passing).agg(F.min("bin")).first()[0]
    return MOST_BINS + 1 if least is None else int(least)


def threshold(docs: DataFrame, text: str = "text", fdr: float = FDR, random_fdr: float = RANDOM_FDR) -> Limits:
    """What counts as found, over all rows: three numbers for the driver."""
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = staged(rows.mapInArrow(_found, "length long, odd double, decades double"))
    mean = found.agg(F.avg("length")).first()[0]
    if mean is None:
        return Limits(1.0, MOST_BINS + 1, MOST_BINS + 1)
    weight = F.log10(F.col("length") / F.lit(mean))
    binned = lambda decades: F.least(F.greatest(F.floor(BINS_A_DECADE * (F.col(decades) + weight)), F.lit(0)), F.lit(MOST_BINS))
    odd = _step_up(found, binned("odd"), random_fdr)
    least = _step_up(found, F.when(binned("odd") >= odd, F.lit(0)).otherwise(binned("decades")), fdr)
    discard(found)
    return Limits(float(mean), odd, least)


def passes(candidate: Candidate, limits: Limits) -> bool:
    """Not shown to be other than random, and shown to be no language."""
    length = candidate.end - candidate.start
    if weighted_decades(length, candidate.odd, limits.mean_length) >= limits.odd:
        return False
    return weighted_decades(length, candidate.decades, limits.mean_length) >= limits.least


def spans_of(text: str, limits: Limits) -> list[tuple[int, int, int]]:
    """All spans of a text (start, kind, end): the fixed patterns', then random runs past the thresholds."""
    spans = base_spans(text)
    known = {(start, end) for start, _, end in spans}
    end = 0
    for c in candidates(text):  # a run comes before its stretches
        if passes(c, limits) and c.end > end:
            end = c.end
            if (c.start, c.end) not in known:
                spans.append((c.start, 3, c.end))
    return sorted(spans)


def masked(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every stretch that spans cover replaced by a mark."""
    out, at = [], 0
    for start, _, end in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def _scanning(limits: Limits, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = [], []
            for value in batch.column("_text"):
                text = value.as_py()
                spans.append(spans_of(text or "", limits))
                texts.append(masked(text, spans[-1]) if spans[-1] else text)
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in one] for one in spans]
            kept = [batch.column(n) for n in names]
            found = pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*kept, found, pa.array(texts, pa.string())], names=[*names, "_spans", "_masked"])

    return run


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), fdr: float = FDR) -> DataFrame:
    """keep columns with _spans (kind, start, end) and _masked, the text with its secrets replaced (null where it is)."""
    limits = threshold(docs, text, fdr)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    schema = f"{kept}, _spans array<struct<kind:string,start:bigint,end:bigint>>, _masked string"
    return rows.mapInArrow(_scanning(limits, list(keep)), schema)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and digests of base spans, and all spans as text."""
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("_spans", lambda s: s["kind"] != "random")
    of = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS[:3]]
    return scanned.select("doc_id", *counts, F.sha2(named(base), 256).alias("base_sha256"), named(F.col("_spans")).alias("spans"))


def digest_of(spans: list[tuple[int, int, int]]) -> str:
    """The base digest of spans, for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans if k < 3).encode()).hexdigest()
