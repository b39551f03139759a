"""Approximate aggregates: exact where they are asked to be, and no sketches by the counted values."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from seqlake import catalog
from seqlake.operators import windows


@pytest.mark.parametrize("p", [0.5, 0.9])
def test_exact_percentile(spark, tmp_path, p):
    """Groups of many different values, of few, with NaN (most, or a few), of NULLs only, of one value, and of the NULL key."""
    g = F.expr("CASE id % 5 WHEN 4 THEN null ELSE 'g' || id % 5 END")
    x = F.expr("CASE id % 5 WHEN 0 THEN cast(hash(id) AS double) WHEN 1 THEN cast(id % 7 AS double) WHEN 2 THEN if(id % 3 = 0, id, double('NaN')) WHEN 3 THEN if(id % 60 = 3, double('NaN'), -id) ELSE if(id % 2 = 0, null, id * 0.5) END")
    rows = spark.range(0, 300_000, 1, 6).select(g.alias("g"), x.alias("x")).unionByName(spark.sql("SELECT 'none' AS g, cast(null AS double) AS x UNION ALL SELECT 'one', 3.0"))
    rows.write.parquet(str(tmp_path / "t"))
    want = duckdb.sql(f"SELECT g, quantile_disc(x, {p}) FROM '{tmp_path}/t/*.parquet' GROUP BY g").fetchall()
    got = windows.exact_percentile(spark.read.parquet(str(tmp_path / "t")), "x", ["g"], p, "m").collect()
    assert len(got) == 7 and {(r.g, str(r.m)) for r in got} == {(k, str(v)) for k, v in want}


def test_no_sketch_for_each_part(spark, sf):
    plan = catalog.queries()["agg_approx"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    sketched = re.findall(r"(?:ObjectHash|Sort|Hash)Aggregate\(keys=\[([^\]]*)\], functions=\[([^\n]*)", plan)
    assert any("approx_count_distinct" in f for _, f in sketched) and any("percentile_approx" in f for _, f in sketched)
    assert not [k for k, f in sketched if "approx" in f and "l_partkey" in k]
