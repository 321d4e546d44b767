"""The streaming extension as a query."""

from __future__ import annotations

from pyspark.sql import DataFrame

from codeloom.plans.bindings import Bound
from codeloom.plans.registry import query
from codeloom.streaming import facts


@query("stream_event_counts", "SELECT date_trunc('day', ts) AS begin, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def event_counts(b: Bound) -> DataFrame:
    return facts.run_once(b.spark, b.sf_dir, "events.parquet")
