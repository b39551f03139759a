"""CSV and JSON records, and their way into the log."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .log import Ack, Writer

# The review schema's CSV header, columns and payload keys.
REVIEW_HEADER = ["Index", "Review ID", "Product Name", "Rating", "Review Text"]
REVIEW_COLUMNS = ["index", "review_id", "product_name", "rating", "review_text"]
REVIEW_SCHEMA = "index long, review_id string, product string, rating long, text string"
REVIEW_KEYS = {"index": "index", "review_id": "review_id", "product": "product_name", "rating": "rating", "text": "review_text"}


def _clean(name: str) -> Column:
    return F.btrim(F.col(name), F.lit(" \t"))


def _number(name: str) -> Column:
    return F.coalesce(_clean(name).try_cast("long"), F.lit(0).cast("long"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Reviews of a CSV with a header; rows with fewer than five fields are left out, bad numbers are 0."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE", schema=", ".join(f"{c} string" for c in [*REVIEW_COLUMNS, "_broken"]), columnNameOfCorruptRecord="_broken", enforceSchema=True)
    whole = raw.where(F.col("review_text").isNotNull() | F.col("_broken").isNull())
    return whole.select(_number("index").alias("index"), _clean("review_id").alias("review_id"), _clean("product_name").alias("product_name"), _number("rating").alias("rating"), F.coalesce(_clean("review_text"), F.lit("")).alias("review_text"))


def to_payload(df: DataFrame, keys: dict[str, str] = REVIEW_KEYS, keep: list[str] | None = None) -> DataFrame:
    """One JSON object per row in a column `data`, beside the columns to keep; keys: payload key -> column."""
    return df.select(*(keep or []), F.to_json(F.struct(*[F.col(c).alias(k) for k, c in keys.items()])).cast("binary").alias("data"))


def append_rows(df: DataFrame, writer: Writer, batch: int = 100, delay: float = 0.0) -> list[Ack]:
    """Send rows (column data) to a local writer, `batch` of them an append; for tables too small to need the data source."""
    acks, held = [], []
    for row in df.toLocalIterator():
        held.append(bytes(row["data"]))
        if len(held) >= batch:
            acks.append(writer.append(held))
            held = []
            time.sleep(delay)
    if held:
        acks.append(writer.append(held))
    return acks


def write_jsonl(df: DataFrame, path: str, seq: str = "seq") -> None:
    """Lines {"seq": n, "row": {...}}."""
    df.select(F.col(seq).alias("seq"), F.struct(*df.columns).alias("row")).write.json(path)


def read_jsonl(spark: SparkSession, path: str, row_schema) -> DataFrame:
    from pyspark.sql.types import LongType, StructType

    schema = StructType().add("seq", LongType()).add("row", row_schema)
    return spark.read.schema(schema).json(path).select("row.*")
