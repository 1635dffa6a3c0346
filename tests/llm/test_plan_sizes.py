"""The driver's memory follows the plans that it keeps: none of the pipeline's may hold many exchanges."""

import re

import corpus_pipeline
import pytest

from quern.llm import curriculum, packing, token_join

DATA, MOST = "/root/testdata/sf0.001", 14


@pytest.fixture
def exchanges(spark, monkeypatch):
    """Numbers of exchanges of the plans that are written, as without joins by broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    found = []

    def count(df):
        found.append(len(re.findall(r"\bExchange (?:hash|range|Single)", df._jdf.queryExecution().executedPlan().toString())))
        return df

    for module in (corpus_pipeline, curriculum, packing, token_join):
        if hasattr(module, "staged"):
            monkeypatch.setattr(module, "staged", lambda df, *a, write=module.staged, **b: write(count(df), *a, **b))
    yield found, count
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("stage", [corpus_pipeline.near_duplicates, corpus_pipeline.mix_sources])
def test_no_plan_of_a_stage_holds_many_exchanges(spark, exchanges, stage):
    found, count = exchanges
    count(stage(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA))
    assert len(found) > 2 and max(found) <= MOST, found
