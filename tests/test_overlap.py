"""The overlapping parts at a size with many files."""

import pytest

from seqlake import catalog
from seqlake.plans.dataset import Dataset


@pytest.mark.parametrize("name", ["no_dedup_overlap", "dedup_overlap"])
def test_no_footers_for_a_schema(spark, sf, monkeypatch, name):
    """The schema is known; without it Spark reads every file's footer, before the query and by one task a core."""
    given, read = [], Dataset.read
    monkeypatch.setattr(Dataset, "read", lambda self, schema=None, buckets=None: given.append(schema) or read(self, schema, buckets))
    out = catalog.queries()[name](spark, sf)
    assert len(given) == 1 and given[0] is not None and given[0].fieldNames() == ["seq", "ts", "user_id", "event_type", "value", "props", "seq_bucket"]
    assert out.select("seq").distinct().count() == 1000 and out.count() == (1666 if name == "no_dedup_overlap" else 1000)
