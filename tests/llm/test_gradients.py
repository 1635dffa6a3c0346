"""Training of the quality classifier: exact gradients, and a passage at the end of a long text that decides."""

import numpy as np
from pyspark.sql import functions as F

from quern.llm import mil_quality


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    text = np.array([0, 0, 1, 2, 2, 2])
    x, y, weight = rng.normal(0, 1, (6, mil_quality.FEATURES)), np.array([1, 0, 1]), np.array([0.2, 0.5, 0.3])
    net = mil_quality.GatedAttention.learned(x.mean(0), x.std(0), np.array([0, 1]), lambda net, chosen, w: {})

    def loss():
        p = net.scores(x, text, 3)
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    found = net._gradients(x, text, y, weight)
    for name, g in found.items():
        flat = net.w[name] = np.array(net.w[name], float)
        for at in rng.choice(flat.size, min(flat.size, 5), replace=False):
            place = np.unravel_index(at, flat.shape)
            held, step = flat[place], 1e-5
            flat[place] = held + step
            up = loss()
            flat[place] = held - step
            down = loss()
            flat[place] = held
            assert abs((up - down) / (2 * step) - g[place]) < 1e-6, name


def test_the_last_passage_of_a_long_text_can_decide(spark):
    rng = np.random.default_rng(1)
    words = ["apple", "river", "stone", "window", "garden", "letter"]
    prose = lambda n: " ".join(rng.choice(words, n))
    rows = []
    for i in range(240):  # all begin with 40 alike passages; the bad ones end in junk
        rows.append((i, prose(3400) + ("#$%^ 9981 @@ || " * 40 if i % 2 else " " + prose(100))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(240)], "doc_id long, quality int")
    scored = mil_quality.score(docs, mil_quality.train(docs, labels)).withColumn("held", mil_quality.held_out(F.col("doc_id")))
    held = [r for r in scored.collect() if r.held]
    assert len(held) > 40 and np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 0) for r in held]) > 0.95
