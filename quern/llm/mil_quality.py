"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE bytes (cut anywhere, so texts without spaces have passages too), all of which are
encoded: shares of character classes, of words by length and case, and of byte pairs by hash. A hidden layer maps a
passage to a representation h; gated attention, softmax over w . (tanh(V h) * sigmoid(U h)), weighs the passages of a
text; the weighted representation is scored by a logistic layer. All layers are learned together from labels of whole
texts.

Training uses at most SAMPLE labelled rows, those with the smallest hash of the id, and all passages of each. Their
features are staged; the driver holds them while they are at most MOST_HELD bytes, beyond that tasks compute the gradients
of the bags of a step and only sums the size of the weights go to the driver. Scoring runs over all passages of all rows.

Defined results: null text is empty; an empty text is one passage without characters and gets its score as any other.
Labels that are null don't count, nor do ids outside the table. Repeated rows each get the same score. With labels of one
class only, all scores are that class's share, and without a label that counts, a half. An empty table gives no rows. Other columns are ignored: labels, language,
source and id are no inputs of a score.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shingles import portions
from quern.session import discard, staged

PASSAGE = 512
SAMPLE = 3000
#: Bytes of features that the driver holds.
MOST_HELD = 64 << 20
PAIR_BUCKETS = 96
HIDDEN, GATE = 24, 12
STEPS, BATCH, RATE, DECAY = 500, 128, 0.01, 1e-4

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence marks, 6 line end, 7 symbols, 8 bytes beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9]] = 1, 2, 3, 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]], _CLASS[[10, 13]] = 5, 6
_CLASS[[ord(c) for c in "#*$%&|<>!@^~=+_{}[]\\/`"]], _CLASS[128:] = 7, 8
CLASSES = 9
FEATURES = CLASSES * CLASSES + CLASSES + 4 + PAIR_BUCKETS


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, text number) of every passage of texts that lie one after another in data."""
    sizes = np.diff(offsets)
    number = np.maximum(1, -(-sizes // PASSAGE))
    text = np.repeat(np.arange(len(sizes)), number)
    first = np.concatenate([[0], np.cumsum(number)])[:-1]
    total = len(text)
    lengths = np.minimum(PASSAGE, sizes[text] - (np.arange(total) - first[text]) * PASSAGE)
    out = np.zeros((total, FEATURES), np.float32)
    if len(data):
        owner = np.repeat(np.arange(total), lengths)
        kind = _CLASS[data]
        n = np.maximum(lengths, 1)[:, None]
        counts = np.bincount(owner * CLASSES + kind, minlength=total * CLASSES).reshape(total, CLASSES)
        out[:, :CLASSES] = counts / n
        inside = owner[1:] == owner[:-1]
        moves = (kind[:-1] * CLASSES + kind[1:])[inside]
        pairs = np.bincount(owner[1:][inside] * CLASSES**2 + moves, minlength=total * CLASSES**2).reshape(total, -1)
        out[:, CLASSES : CLASSES + CLASSES**2] = pairs / n
        at = CLASSES + CLASSES**2
        letters = counts[:, 1] + counts[:, 2] + counts[:, 8]
        words = pairs[:, [4 * CLASSES + 1, 4 * CLASSES + 2, 4 * CLASSES + 8]].sum(axis=1) + 1
        out[:, at] = np.minimum(letters / words, 30) / 30
        out[:, at + 1] = lengths / PASSAGE
        lines = counts[:, 6] + 1
        out[:, at + 2] = np.minimum(lengths / lines, 400) / 400
        present = np.zeros((total, 256), bool)
        present[owner, data] = True
        out[:, at + 3] = present.sum(axis=1) / 64
        low = data.astype(np.int64)
        hashed = ((low[:-1] * 257 + low[1:]) * 2654435761 >> 7) % PAIR_BUCKETS
        out[:, at + 4 :] = np.bincount(owner[1:][inside] * PAIR_BUCKETS + hashed[inside], minlength=total * PAIR_BUCKETS).reshape(total, -1) / n
    return out, text


def _softmax(logits: np.ndarray, text: np.ndarray, number: int) -> np.ndarray:
    """Weights of passages within their text; text ascends."""
    first = np.searchsorted(text, np.arange(number))
    logits = np.exp(logits - np.maximum.reduceat(logits, first)[text])
    return logits / np.add.reduceat(logits, first)[text]


class GatedAttention:
    """Weights of the network; `scores` runs it forward, `fit` learns it."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    def _forward(self, x: np.ndarray, text: np.ndarray, number: int) -> tuple:
        w = self.w
        z = (x - w["mean"]) / w["spread"]
        h = np.tanh(z @ w["W"] + w["b"])
        tanh, gate = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        a = _softmax((tanh * gate) @ w["a"], text, number)
        bag = np.add.reduceat(a[:, None] * h, np.searchsorted(text, np.arange(number)))
        return z, h, tanh, gate, a, bag, 1 / (1 + np.exp(-np.clip(bag @ w["c"] + w["d"], -30, 30)))

    def scores(self, x: np.ndarray, text: np.ndarray, number: int) -> np.ndarray:
        return self._forward(x, text, number)[-1] if number else np.zeros(0)

    @classmethod
    def fit(cls, x: np.ndarray, text: np.ndarray, y: np.ndarray, seed: int = 7) -> GatedAttention:
        """Adam on the logistic loss, each class weighing the same; x, text: passages, sorted by text; y by text."""
        first = np.searchsorted(text, np.arange(len(y) + 1))

        def gradients(net: GatedAttention, chosen: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in chosen])
            own = np.repeat(np.arange(len(chosen)), first[chosen + 1] - first[chosen])
            return net._gradients(x[rows].astype(np.float64), own, y[chosen], weight)

        return cls.learned(x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64), y, gradients, seed)

    @classmethod
    def learned(cls, mean: np.ndarray, spread: np.ndarray, y: np.ndarray, gradients: Callable[[GatedAttention, np.ndarray, np.ndarray], dict[str, np.ndarray]], seed: int = 7) -> GatedAttention:
        """Adam over steps of BATCH texts; gradients: of the network at chosen texts with their weights, divided by their number."""
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        w = {"W": normal(len(mean), HIDDEN), "b": np.zeros(HIDDEN), "V": normal(HIDDEN, GATE), "U": normal(HIDDEN, GATE), "a": normal(GATE), "c": normal(HIDDEN), "d": np.zeros(())}
        net = cls(w | {"mean": mean, "spread": spread + 1e-3})
        share = y.mean() if len(y) else 0.5
        if not len(y) or share in (0.0, 1.0):
            net.w |= {"c": np.zeros(HIDDEN), "d": np.array(60 * share - 30)}
            return net
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
        for step in range(1, STEPS + 1):
            chosen = np.sort(rng.choice(len(y), min(BATCH, len(y)), replace=False))
            for k, g in gradients(net, chosen, weight[chosen] / len(chosen)).items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                moment[k] = (m, v)
                rate = RATE * (1 - step / (STEPS + 1))
                net.w[k] = net.w[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) - rate * DECAY * net.w[k]
        return net

    def _gradients(self, x: np.ndarray, text: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        z, h, tanh, gate, a, bag, p = self._forward(x, text, len(y))
        error = (p - y) * weight
        to_bag = error[:, None] * w["c"]
        to_h = a[:, None] * to_bag[text]
        to_a = (h * to_bag[text]).sum(axis=1)
        first = np.searchsorted(text, np.arange(len(y)))
        to_logit = a * (to_a - np.add.reduceat(a * to_a, first)[text])
        to_both = to_logit[:, None] * w["a"]
        to_tanh, to_gate = to_both * gate * (1 - tanh**2), to_both * tanh * gate * (1 - gate)
        to_h = to_h + to_tanh @ w["V"].T + to_gate @ w["U"].T
        to_in = to_h * (1 - h**2)
        return {"W": z.T @ to_in, "b": to_in.sum(axis=0), "V": h.T @ to_tanh, "U": h.T @ to_gate, "a": (tanh * gate).T @ to_logit, "c": bag.T @ error, "d": error.sum()}


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of all passages of each labelled text."""
    for batch in batches:
        for part, data, offsets in portions(batch, "_text"):
            x, text = passages(data, offsets)
            ends = np.searchsorted(text, np.arange(len(part) + 1))
            rows = [x[a:b].tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array(rows, pa.binary())], names=["quality", "features"])


def _bag(features: bytes) -> np.ndarray:
    return np.frombuffer(features, np.float32).reshape(-1, FEATURES)


def _summed(bags: DataFrame, of: Callable[[int, np.ndarray], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sums over bags (_id, features) of arrays whose size does not depend on the bag: one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least = {}, None
        for batch in batches:
            for i, features in zip(batch.column("_id").to_pylist(), batch.column("features")):
                least = i if least is None else least
                for k, v in of(i, _bag(features.as_buffer()).astype(np.float64)).items():
                    total[k] = total[k] + v if k in total else v
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([least], pa.int64()), pa.array([pickle.dumps(total)], pa.binary())], names=["least", "total"])

    parts = [pickle.loads(r["total"]) for r in sorted(bags.select("_id", "features").mapInArrow(run, "least long, total binary").collect(), key=lambda r: r["least"])]
    return {k: sum((p[k] for p in parts[1:]), parts[0][k]) for k in parts[0]}


def _fit_by_tasks(bags: DataFrame, ids: np.ndarray, y: np.ndarray) -> GatedAttention:
    """As `GatedAttention.fit` on bags (_id, features), ids in the order of y; the driver gets sums only."""
    sums = _summed(bags, lambda i, x: {"n": np.array(len(x)), "s": x.sum(axis=0)})
    mean = sums["s"] / sums["n"]
    spread = np.sqrt(_summed(bags, lambda i, x: {"s": ((x - mean) ** 2).sum(axis=0)})["s"] / sums["n"])

    def gradients(net: GatedAttention, chosen: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        goal = {int(ids[n]): (y[n : n + 1], weight[k : k + 1]) for k, n in enumerate(chosen)}
        return _summed(bags.filter(F.col("_id").isin(list(goal))), lambda i, x: net._gradients(x, np.zeros(len(x), np.int64), *goal[i]))

    return GatedAttention.learned(mean, spread, y, gradients)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> GatedAttention:
    """Learn from at most `sample` rows of labels (doc_id, quality) that are not held out."""
    known = labels.filter(~held_out(F.col("doc_id"))).filter("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "_id")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    seen = texts.select("quality", "_text").mapInArrow(_seen, "quality int, features binary")
    bags = staged(seen.select(F.monotonically_increasing_id().alias("_id"), "quality", "features", F.sha2("features", 256).alias("_k")))
    rows = bags.select("_id", "quality", "_k", F.length("features").alias("size")).toPandas().sort_values(["_k", "quality"])  # `sample` rows of four short values
    if not len(rows):
        net = GatedAttention.fit(np.zeros((1, FEATURES)), np.zeros(1, np.int64), np.zeros(0))
    elif rows["size"].sum() > MOST_HELD:
        net = _fit_by_tasks(bags, rows["_id"].to_numpy(), rows.quality.to_numpy())
    else:
        held = dict(bags.select("_id", "features").toPandas().itertuples(index=False))
        found = [_bag(held.pop(i)) for i in rows["_id"]]
        text = np.repeat(np.arange(len(found)), [len(b) for b in found]).astype(np.int64)
        net = GatedAttention.fit(np.concatenate(found), text, rows.quality.to_numpy())
    discard(bags)
    return net


def _scoring(net: GatedAttention, text: str, drop: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in portions(batch, text):
                x, owner = passages(data, offsets)
                found = pa.array(net.scores(x, owner, len(part)), pa.float64())
                kept = [n for n in part.schema.names if not (drop and n == text)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), found], names=[*kept, "score"])

    return run


def score(docs: DataFrame, net: GatedAttention, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns and the score of each row's whole text."""
    drop = text not in keep
    rows = docs.select(*keep, *([text] if drop else []))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if not (drop and f.name == text))
    return rows.mapInArrow(_scoring(net, text, drop), f"{kept}, score double")
