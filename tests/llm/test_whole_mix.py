"""The mixing stage on rows that repeat."""

from collections import Counter

import corpus_pipeline
from quern.llm import curriculum
from quern.llm.words import n_words


def test_repeated_rows_come_up_as_often_as_the_mix_takes_them(spark):
    rows = [(1, "five words stand in here", "en", "a", 24)] * 4 + [(1, "five words stand in here", "de", "a", 24), (1, "five words stand in here", "en", "b", 24)]
    rows += [(i, f"some other words of row {i}", "en", "ab"[i % 2], 20) for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    taken = Counter()
    for r in mixed:
        taken[r.source] += len(r.text.split())
    targets = curriculum.source_targets(docs.select("doc_id", "source", n_words("text").alias("size"))).collect()
    assert all(abs(taken[t.source] - t.target) <= 1 for t in targets)
    limit = {k: 3 * n for k, n in Counter(r[:4] for r in rows).items()}
    whole = Counter((r.doc_id, r.text, r.lang, r.source) for r in mixed if len(r.text.split()) >= 5)
    assert all(n <= limit.get(k, n) for k, n in whole.items())
