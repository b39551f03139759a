"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Targets: the sources' weights share all words; a target stops at three times
its source's size and the excess is shared again by weight until none is above.
A source is dealt by a hash into shards of about SHARD words, so a source that
holds a third of the corpus is many shards. Blocks of BLOCK words are the
seats: each shard's quotients are its part of the source's target over 1, 3, 5,
..., and the highest quotients of all get a block each, ties by source (null
last) and shard. The last quotient served is found by counting, so no task
ranks all of them.
A shard's quota is first spent on whole passes over it, then on its first
blocks in a seeded order of its documents: of one document a shard a part is
taken, its first words, and all others are taken whole. So a shard's plan is a
few numbers and the place of its cut, and texts meet it in a join that Spark
broadcasts while the plans are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, settle, threshold

BLOCK, SHARD, MOST, SEED = 32, 2_000_000, 3, "mix"
WHITE = r"[\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\f\r"
#: Quotients either side of a shard's expected seats that are compared.
AROUND = 2


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null: 0."""
    body = F.btrim(text, F.lit(BLANK))
    return F.when(F.coalesce(body, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(body, WHITE))).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word's end, white space as it is; n from 1 to the words that it has."""
    words, gaps = F.filter(F.split(text, WHITE), lambda w: w != ""), F.regexp_extract_all(text, F.lit(WHITE), F.lit(0))
    long_ = lambda xs, k: F.aggregate(F.slice(xs, F.lit(1), k.cast("int")), F.lit(0), lambda a, x: a + F.length(x))
    leads = F.when(F.length(F.ltrim(text, F.lit(BLANK))) < F.length(text), 1).otherwise(0)
    # The outer transform binds the parts, so that a text is split once.
    end = F.transform(F.array(F.struct(words.alias("w"), gaps.alias("g"))), lambda x: long_(x["w"], n) + long_(x["g"], n - 1 + leads))
    return F.substring(text, F.lit(1), F.element_at(end, 1))


def weights(sources: DataFrame) -> DataFrame:
    """sources (source, ...) with weight 1, 2, 3, 1, ... by code point, null last."""
    placed = numbered(sources, [F.col("source").asc_nulls_last()], "_at")
    return placed.withColumn("weight", (F.col("_at") % 3 + 1).cast("long")).drop("_at")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size, weight)."""
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return sources.select("source", "source_size", F.lit(0.0).alias("target"))
    level, full = total / weight, F.col("source_size") * most
    while True:
        above = full < F.col("weight") * level
        held, open_ = sources.agg(F.sum(F.when(above, full).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        new = (total - held) / open_ if open_ else level
        if new == level:
            break
        level = new
    return sources.select("source", "source_size", F.when(above, full.cast("double")).otherwise(F.col("weight") * level).alias("target"))


def quotas(shards: DataFrame, total: int) -> DataFrame:
    """shards (source, shard, part, ...) with quota: the blocks that the highest quotients part / (2k + 1) give, as many as `total` words fill."""
    seats, around = round(total / BLOCK), AROUND
    if not seats:
        return shards.withColumn("quota", F.lit(0).cast("long"))
    quotient = lambda k: F.col("part") / (k * 2 + 1)
    expected = F.floor((F.col("part") / (BLOCK / 2) + 1) / 2)
    while True:
        first = F.greatest(F.lit(0), expected - around)
        some = shards.where("part > 0")
        sure = some.agg(F.sum(first)).first()[0] or 0
        near = some.select("part", F.explode(F.sequence(first, expected + around)).alias("k")).select(quotient(F.col("k")).alias("key"))
        if seats - sure > 0:
            least = threshold(near, seats - sure)
            least = near.agg(F.min("key")).first()[0] if least is None else least
            # Counted by the quotients themselves, as a division by `least` is rounded.
            low = F.greatest(F.lit(0), F.floor((F.col("part") / least + 1) / 2) - 1)
            served = low + sum((quotient(low + i) >= least).cast("long") for i in range(3))
            off = some.agg(F.max(F.abs(served - expected))).first()[0]
            if off <= around:
                break
        around *= 4
    shards = settle(shards.withColumn("quota", F.when(F.col("part") > 0, served).otherwise(0).cast("long")))
    over = shards.agg(F.sum("quota")).first()[0] - seats
    if over <= 0:
        return shards
    tied = shards.where((F.col("quota") > 0) & (quotient(F.col("quota") - 1) == least)).select("source", "shard")
    last = numbered(tied, [F.col("source").desc_nulls_first(), F.col("shard").desc()], "at").where(F.col("at") < over)
    last = settle(last.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), F.lit(1).alias("less")))
    same = shards["source"].eqNullSafe(last["_source"]) & (shards["shard"] == last["_shard"])
    return shards.join(last, same, "left").withColumn("quota", F.col("quota") - F.coalesce("less", F.lit(0))).drop("_source", "_shard", "less")


def _named(doc_id: Column, text: Column, seed: str) -> Column:
    """A document's place in the seeded order; rows that share it have equal ids and texts."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def _shard(order: Column, count: Column) -> Column:
    return F.pmod(F.conv(F.substring(order, 1, 8), 16, 10).cast("long"), count)


def _with(rows: DataFrame, goal: DataFrame, plan: DataFrame, source: str, order: str) -> DataFrame:
    """rows with their source's goal and their shard's plan. Spark broadcasts either if it is small, else splits a hot source's rows."""
    near = rows.join(goal, rows[source].eqNullSafe(goal["_llm_source"])).drop("_llm_source")
    near = near.withColumn("_llm_at", _shard(F.col(order), F.col("_llm_shards")))
    same = near[source].eqNullSafe(plan["_llm_of"]) & (near["_llm_at"] == plan["_llm_shard"])
    return near.join(plan, same, "left").withColumn("_llm_passes", F.coalesce("_llm_passes", F.lit(0))).drop("_llm_of", "_llm_shard", "_llm_at")


def plans(docs: DataFrame, seed: str = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, goal, plan): rows (doc_id, source, size, order); goal: a row a source; plan: a row a shard, with the
    passes over it, its cut (documents before it in the order are taken once more) and the words of the cut document."""
    order = _named(F.col("doc_id"), F.col("text"), seed)
    rows = settle(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order.alias("order")))
    sources = settle(weights(rows.groupBy("source").agg(F.sum("size").alias("source_size"))))
    goal = settle(targets(sources).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD))))
    total = goal.agg(F.sum("source_size")).first()[0] or 0
    own = goal.select(F.col("source").alias("_source"), "source_size", "target", "shards")
    joined = rows.join(own, rows["source"].eqNullSafe(F.col("_source"))).drop("_source")
    joined = joined.withColumn("shard", _shard(F.col("order"), F.col("shards")))
    # Rows with equal ids and texts share a place and are taken alike; a shard's words bound how many places it has.
    units = settle(joined.where("size > 0").groupBy("source", "shard", "order", "size").agg(F.count("*").alias("times"), F.first("target").alias("target"), F.first("source_size").alias("source_size")))
    many = F.col("size") * F.col("times")
    shards = units.groupBy("source", "shard").agg(F.sum(many).alias("shard_size"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    part = F.when(F.col("source_size") > 0, F.col("target") * F.col("shard_size") / F.col("source_size")).otherwise(0.0)
    quota = settle(quotas(settle(shards.select("source", "shard", "shard_size", part.alias("part"))), total))
    words = F.expr(f"least(quota * {BLOCK}L, shard_size * {MOST}L)")
    quota = quota.withColumn("words", words).withColumn("passes", F.when(F.col("shard_size") > 0, F.expr("words div shard_size")).otherwise(0))
    quota = quota.withColumn("rest", F.col("words") - F.col("passes") * F.col("shard_size"))
    quota = settle(quota.select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "passes", "rest"))
    both = units.join(quota, units["source"].eqNullSafe(quota["_source"]) & (units["shard"] == quota["_shard"])).drop("_source", "_shard")
    run = Window.partitionBy("source", "shard").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("lo", F.sum(many).over(run) - many)
    at_cut = (F.col("lo") <= F.col("rest")) & (F.col("rest") < F.col("lo") + many)
    plan = both.groupBy("source", "shard").agg(
        F.first("passes").alias("_llm_passes"), F.max(F.when(at_cut, F.col("order"))).alias("_llm_cut"),
        F.max(F.when(at_cut, F.expr("(rest - lo) div times"))).alias("_llm_cut_words"),
    )
    plan = settle(plan.withColumnsRenamed({"source": "_llm_of", "shard": "_llm_shard"}))
    goal = goal.select(F.col("source").alias("_llm_source"), F.col("source_size").alias("_llm_size"), F.col("target").alias("_llm_target"), F.col("shards").alias("_llm_shards"))
    return rows, goal, plan


def _more(order: str, size: Column) -> Column:
    """The words that a document has taken beside whole passes. A shard without words has no plan and no cut."""
    cut = F.col("_llm_cut")
    return F.when(F.col(order) < cut, size).when(F.col(order) == cut, F.col("_llm_cut_words")).otherwise(F.lit(0))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    A null text has size 0 and takes nothing. A null source is a source, the
    last. Rows that repeat a doc_id, or have none, are documents of their own;
    those with equal texts as well are taken alike. Words of a corpus without
    any: all targets 0. An empty table gives an empty result. Only doc_id, text
    and source are read. The seed decides which documents a quota is spent on.
    """
    rows, goal, plan = plans(docs, seed)
    taken = F.col("_llm_passes") * F.col("size") + _more("order", F.col("size"))
    return _with(rows, goal, plan, "source", "order").select("doc_id", "size", F.col("_llm_size").alias("source_size"), F.col("_llm_target").alias("target"), taken.cast("long").alias("taken"))


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(docs)


def remix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs as the mix takes them: a copy for each pass, another of the documents before their shard's cut, and the first words of the one at it.

    Such a part is the text as it stands up to a word's end. n_chars, where it
    exists, follows the text. Documents without words are taken by no mix and
    go. Nulls, ties and repeated rows: as in mix(). An empty table stays empty.
    docs may have any columns but such that begin with _llm_.
    """
    _, goal, plan = plans(docs, seed)
    size = n_words(F.col("text"))
    named = docs.withColumns({"_llm_order": _named(F.col("doc_id"), F.col("text"), seed), "_llm_words": size})
    both = _with(named.where("_llm_words > 0"), goal, plan, "source", "_llm_order").withColumn("_llm_more", _more("_llm_order", F.col("_llm_words")).cast("long"))
    part = (F.col("_llm_more") > 0) & (F.col("_llm_more") < F.col("_llm_words"))
    whole = F.col("_llm_passes") + F.when(F.col("_llm_more") == F.col("_llm_words"), 1).otherwise(0)
    copies = F.concat(F.array_repeat(F.lit(False), whole.cast("int")), F.array_repeat(F.lit(True), F.when(part, 1).otherwise(0)))
    both = both.withColumn("_llm_part", F.explode(copies))
    text = F.when(F.col("_llm_part"), first_words(F.col("text"), F.col("_llm_more"))).otherwise(F.col("text"))
    cols = [text.alias(c) if c == "text" else F.when(F.col("_llm_part"), F.length(text)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return both.select(*cols)


OP8_SQL = f"""
WITH w AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS o FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM w GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS wt FROM s0),
s2 AS (SELECT *, sum(s) OVER () AS total,
    coalesce(sum({MOST} * s) OVER (ORDER BY {MOST} * s / wt, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(wt) OVER (ORDER BY {MOST} * s / wt, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s1),
lv AS (SELECT max(CAST(total - held AS DOUBLE) / CAST(open AS DOUBLE)) AS level FROM s2 WHERE {MOST} * s * open >= wt * (total - held)),
s3 AS (SELECT source, s, CASE WHEN {MOST} * s < wt * level THEN CAST({MOST} * s AS DOUBLE) ELSE wt * level END AS target FROM s1, lv),
d AS (SELECT w.*, s3.s, s3.target, CAST('0x' || substr(o, 1, 8) AS BIGINT) % greatest(1, CAST(ceil(s3.s / {SHARD}) AS BIGINT)) AS shard
  FROM w JOIN s3 ON w.source IS NOT DISTINCT FROM s3.source),
c AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS cs, any_value(target) * CAST(sum(size) AS BIGINT) / any_value(s) AS part FROM d GROUP BY source, shard HAVING any_value(s) > 0),
q AS (SELECT source, shard, part / (2 * k + 1) AS quotient FROM (SELECT *, unnest(range(0, CAST(part / {BLOCK // 2} AS BIGINT) + 3)) AS k FROM c WHERE part > 0)),
won AS (SELECT source, shard, count(*) AS quota FROM (
    SELECT * FROM q ORDER BY quotient DESC, source NULLS LAST, shard LIMIT (SELECT CAST(round(sum(cs) / {float(BLOCK)}) AS BIGINT) FROM c)) GROUP BY source, shard),
e AS (SELECT c.source, c.shard, cs, least(coalesce(quota, 0) * {BLOCK}, cs * {MOST}) AS words
  FROM c LEFT JOIN won ON c.source IS NOT DISTINCT FROM won.source AND c.shard = won.shard),
u AS (SELECT source, shard, o, size, count(*) AS m FROM d GROUP BY source, shard, o, size),
p AS (SELECT u.*, e.words // greatest(cs, 1) AS passes, words - (words // greatest(cs, 1)) * cs AS rest,
    CAST(sum(size * m) OVER (PARTITION BY u.source, u.shard ORDER BY o ROWS UNBOUNDED PRECEDING) AS BIGINT) - size * m AS lo
  FROM u JOIN e ON u.source IS NOT DISTINCT FROM e.source AND u.shard = e.shard)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, d.s AS source_size, d.target,
  CAST(coalesce(passes * p.size + greatest(0, least(p.size * m, rest - lo)) // m, 0) AS BIGINT) AS taken
FROM d LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.shard = p.shard AND d.o = p.o
"""
