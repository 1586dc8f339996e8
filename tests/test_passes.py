"""How often fitted queries go over the weekly facts: their steps read what was written once, whatever their number."""

from __future__ import annotations

import pytest

from weekloom.plans import registry
from weekloom.sources import tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def passes(spark, monkeypatch, tmp_path):
    """A function that gives the rows read so far over the rows of the weekly facts."""
    path = str(tmp_path / "facts")
    tables.weekly(spark, DATA).write.parquet(path)
    facts = spark.read.parquet(path)
    read, total = spark.sparkContext.accumulator(0), facts.count()

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(tables, "weekly_from_lines", lambda lines, orders: facts.mapInArrow(counted, facts.schema))
    return lambda: read.value / total


@pytest.mark.parametrize(
    ("name", "most"),
    [
        ("model_score_new", 1),
        ("model_score_weeks", 2),  # the fit, and the weeks that it scores
        ("psm_score", 1),
        ("model_ablation", 1),
        ("es_controlled_profile", 1),
    ],
)
def test_weeks_are_read_once(spark, passes, name, most):
    assert registry.queries()[name](spark, DATA).collect()
    assert 0 < passes() <= most
