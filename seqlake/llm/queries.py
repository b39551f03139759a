"""The operators' registered queries, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import langid, licenses, mixing, packing, pii, quality, simhash, urls, vectors
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(operator: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: operator(spark, *[table(spark, sf_dir, t) for t in tables])


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": _over(simhash.op1, "documents"),
        "op2_ann": _over(vectors.op2, "embeddings"),
        "op3_langid": _over(langid.op3, "documents"),
        "op4_url_filter": _over(urls.op4, "pages"),
        "op5_topk": _over(vectors.op5, "embeddings"),
        "op6_quality": _over(quality.op6, "documents", "labels"),
        "op7_packing": _over(packing.op7, "documents"),
        "op8_mixing": _over(mixing.op8, "documents"),
        "op9_pii": _over(pii.op9, "documents"),
        "op10_licenses": _over(licenses.op10, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": urls.OP4_SQL, "op5_topk": vectors.OP5_SQL, "op8_mixing": mixing.OP8_SQL}
