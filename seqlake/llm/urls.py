"""URL filters: a temporal list join, in DataFrame operations only.

Dated list entries (list, kind, value, action, on) become validity intervals:
an `add` holds from its day until the entry's next day of any action. Captures
are evaluated against the entries active on the day they were fetched. A
capture asks for its host, each parent domain, and each path prefix of its
URL, as far as the list's entries go; entries are cut at month ends, so the as-of join is an equi-join on
(kind, value, month) with a range condition that at most one interval of an
entry meets. A hot host is spread over months and split further by Spark as a
skewed join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle

# Hosts that the demonstration list names, and their days in it.
SPAM = [("cheap-pills.example.com", "2024-02-01"), ("spam-farm.example.org", "2024-03-15"), ("localhost", "2024-01-10")]
END = "9999-12-31"
SCHEME = r"(?i)^[a-z][a-z0-9+.-]*://"
#: Hosts that are addresses have no parent domains.
ADDRESS = r"^[0-9]+(\.[0-9]+){3}$|^\["


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, value, since, until) from dated entries; until is exclusive.

    Entries with a null field take no part. Of several entries on one day, a
    `remove` wins; repeated rows count once; an entry that was removed may be
    added again. Hosts are compared in lower case, paths as they are.
    """
    value, slash = F.col("value"), F.instr("value", "/")
    own = F.when(F.col("kind") == "prefix", F.concat(F.lower(F.substring_index(value, "/", 1)), F.when(slash > 0, F.substring(value, slash, F.length(value))).otherwise(""))).otherwise(F.lower(value))
    e = entries.select("list", "kind", own.alias("value"), "action", F.col("on").cast("date").alias("on")).dropna()
    day = e.groupBy("list", "kind", "value", "on").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("gone"))
    run = Window.partitionBy("list", "kind", "value").orderBy("on")
    until = F.coalesce(F.lead("on").over(run), F.lit(END).cast("date"))
    return day.select("list", "kind", "value", F.col("on").alias("since"), until.alias("until"), "gone").where("gone = 0").drop("gone")


def host_of(url: Column) -> Column:
    """The lower-case host: scheme, user, port, path, query, fragment and a last dot cut off; '' if there is none."""
    place = F.regexp_extract(F.regexp_replace(url, SCHEME, ""), r"^([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", ""))


def path_of(url: Column) -> Column:
    """What follows the host's slash, up to a query or fragment."""
    return F.regexp_extract(F.regexp_replace(url, SCHEME, ""), r"^[^/?#]*/([^?#]*)", 1)


def lookups(url: Column, labels_most: Column, steps_most: Column) -> Column:
    """Array of (kind, value): the host and its parent domains of at most so many labels, and host/path up to each of so many slashes."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    first = F.greatest(F.lit(1), n - labels_most + 1)
    ends = F.when(F.regexp_like(host, F.lit(ADDRESS)) | (labels_most < 1), F.array().cast("array<int>")).otherwise(F.sequence(first, F.greatest(first, n)))
    whole = F.array(F.struct(F.lit("domain").alias("kind"), host.alias("value")))
    domains = F.transform(ends, lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("value")))
    steps = F.split(path_of(url), "/", -1)
    upto = F.least(F.size(steps), steps_most)
    prefixes = F.transform(
        F.when(upto < 1, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(1), upto), lambda i: F.element_at(steps, i) != "")),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("value")),
    )
    return F.array_distinct(F.filter(F.concat(whole, domains, prefixes), lambda x: x["value"] != ""))


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, day: Column) -> DataFrame:
    """One row per capture: id, host, fetched_on, hits, lists, blocked.

    blocked: an entry of a list other than `allow` is active and none of
    `allow`. A `domain` entry meets a host and those under it, one without a
    dot (a top-level domain) as well; a host that is an address has none under
    it. A null URL has host null, no hits and isn't blocked; neither is a
    capture with a null day. Captures that repeat an id get a row each. An
    empty list blocks nothing. A URL of any length asks for no more domains and
    prefixes than the longest entries have labels and steps.
    """
    own = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), day.cast("date").alias("fetched_on"))
    held = settle(intervals(entries))
    months = F.sequence(F.trunc("since", "month"), F.least(F.trunc(F.date_sub("until", 1), "month"), F.greatest(F.trunc("last", "month"), F.trunc("since", "month"))), F.expr("interval 1 month"))
    # A list entry that never ends reaches to the last capture's month; the two days are one row.
    span = own.agg(F.max("fetched_on").alias("last"))
    parts = lambda kind, mark: F.coalesce(F.max(F.when(F.col("kind") == kind, F.size(F.split("value", mark)))), F.lit(0))
    most = held.agg(parts("domain", r"\.").alias("labels_most"), (parts("prefix", "/") - 1).alias("steps_most"))
    held = settle(held.join(F.broadcast(span)).where(F.col("since") <= F.col("last")).select("list", "kind", "value", "since", "until", F.explode(months).alias("month")))
    asked = own.join(F.broadcast(most)).select("id", "url", "fetched_on", F.trunc("fetched_on", "month").alias("month"), F.explode(lookups(F.col("url"), F.col("labels_most"), F.col("steps_most"))).alias("key"))
    asked = asked.select("id", "url", "fetched_on", "month", F.col("key.kind").alias("kind"), F.col("key.value").alias("value"))
    active = asked.join(held, ["kind", "value", "month"]).where("since <= fetched_on and fetched_on < until")
    found = active.groupBy("id", "url", "fetched_on").agg(F.count_distinct("list", "kind", "value").alias("hits"), F.array_sort(F.collect_set("list")).alias("lists"))
    found = settle(found)
    same = own["id"].eqNullSafe(found["id"]) & (own["url"] == found["url"]) & (own["fetched_on"] == found["fetched_on"])
    lists = F.coalesce(found["lists"], F.array().cast("array<string>"))
    return own.join(found, same, "left").select(
        own["id"], host_of(own["url"]).alias("host"), own["fetched_on"], F.coalesce("hits", F.lit(0)).alias("hits"),
        F.array_join(lists, ",").alias("lists"), ((F.size(lists) > 0) & ~F.array_contains(lists, "allow")).alias("blocked"),
    )


def demo_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the tables at hand, which have no lists of their own.

    SPAM's hosts are listed as domains from their days on. A host whose md5
    begins with 0-3 is listed on a day of its own, taken off 60 days later,
    listed again after 120, and after 180 both listed and taken off. One with 4
    is allowed from the year's begin to its day. The first path step of a page
    whose URL's md5 begins with 0 is listed as a prefix for 30 days, and again
    after 90.
    """
    fixed = pages.sparkSession.createDataFrame([("spam", "domain", h, "add", d) for h, d in SPAM], "list string, kind string, value string, action string, on string")
    year = F.lit("2024-01-01").cast("date")
    hosts = pages.where("url is not null").select(host_of(F.col("url")).alias("h")).distinct()
    first, start = F.substring(F.md5("h"), 1, 1), F.date_add(year, F.ascii(F.substring(F.md5("h"), 2, 1)) * 3)
    step = F.regexp_extract(path_of(F.col("url")), r"^([^/]+)", 1)
    prefix = pages.where("url is not null").where(F.substring(F.md5("url"), 1, 1) == "0").where(step != "").select(F.concat(host_of(F.col("url")), F.lit("/"), step).alias("p"), F.ascii(F.substring(F.md5("url"), 2, 1)).alias("a"))
    prefix = prefix.groupBy("p").agg(F.min("a").alias("a"))
    begin = F.date_add(year, F.col("a") * 2)

    def dated(df: DataFrame, name: str, kind: str, value: str, days: list[tuple[str, Column]]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(action).alias("action"), on.alias("on")) for action, on in days]))
        return df.select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), F.col(value).alias("value"), each.alias("d")).select("list", "kind", "value", "d.action", "d.on")

    abuse = dated(hosts.where(first.isin("0", "1", "2", "3")), "abuse", "domain", "h", [("add", start), ("remove", F.date_add(start, 60)), ("add", F.date_add(start, 120)), ("add", F.date_add(start, 180)), ("remove", F.date_add(start, 180))])
    allow = dated(hosts.where(first == "4"), "allow", "domain", "h", [("add", year), ("remove", start)])
    paths = dated(prefix, "paths", "prefix", "p", [("add", begin), ("remove", F.date_add(begin, 30)), ("add", F.date_add(begin, 90))])
    return fixed.withColumn("on", F.col("on").cast("date")).unionAll(abuse).unionAll(allow).unionAll(paths)


def op4(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """All pages. They have no fetch day: 2024-01-01 plus page_id mod 366 days stands for it."""
    narrow = pages.select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    found = filter_captures(narrow, demo_entries(narrow), "page_id", "url", day)
    return found.select(F.col("id").alias("page_id"), "host", F.col("fetched_on").cast("string").alias("fetched_on"), "hits", "lists", "blocked")


_SPAM_SQL = " UNION ALL ".join(f"SELECT 'spam' AS list, 'domain' AS kind, '{h}' AS value, 'add' AS action, DATE '{d}' AS day" for h, d in SPAM)
OP4_SQL = f"""
WITH p AS (
  SELECT page_id, url, regexp_replace(url, '{SCHEME}', '') AS u, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched_on FROM pages),
h AS (
  SELECT *, lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(u, '^([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '')) AS host,
    regexp_extract(u, '^[^/?#]*/([^?#]*)', 1) AS path FROM p),
hosts AS (SELECT DISTINCT host AS h, CAST(DATE '2024-01-01' + CAST(ascii(substr(md5(host), 2, 1)) * 3 AS INTEGER) AS DATE) AS start FROM h WHERE url IS NOT NULL),
pre AS (
  SELECT host || '/' || regexp_extract(path, '^([^/]+)', 1) AS p, CAST(DATE '2024-01-01' + CAST(min(ascii(substr(md5(url), 2, 1))) * 2 AS INTEGER) AS DATE) AS start
  FROM h WHERE md5(url) LIKE '0%' AND regexp_extract(path, '^([^/]+)', 1) <> '' GROUP BY 1),
entries AS (
  {_SPAM_SQL}
  UNION ALL SELECT 'abuse', 'domain', h, action, CAST(start + after AS DATE) FROM hosts, (VALUES ('add', 0), ('remove', 60), ('add', 120), ('add', 180), ('remove', 180)) v(action, after) WHERE substr(md5(h), 1, 1) IN ('0', '1', '2', '3')
  UNION ALL SELECT 'allow', 'domain', h, 'add', DATE '2024-01-01' FROM hosts WHERE md5(h) LIKE '4%'
  UNION ALL SELECT 'allow', 'domain', h, 'remove', start FROM hosts WHERE md5(h) LIKE '4%'
  UNION ALL SELECT 'paths', 'prefix', p, action, CAST(start + after AS DATE) FROM pre, (VALUES ('add', 0), ('remove', 30), ('add', 90)) v(action, after)),
days AS (SELECT list, kind, value, day, bool_or(action = 'remove') AS gone FROM entries GROUP BY ALL),
held AS (
  SELECT list, kind, value, day AS since, until FROM (
    SELECT *, coalesce(lead(day) OVER (PARTITION BY list, kind, value ORDER BY day), DATE '{END}') AS until FROM days) WHERE NOT gone),
hit AS (
  SELECT h.page_id, h.url, count(*) AS hits, string_agg(DISTINCT e.list, ',' ORDER BY e.list) AS lists, bool_or(e.list = 'allow') AS fine
  FROM (SELECT DISTINCT page_id, url, host, path, fetched_on FROM h) h JOIN held e ON e.since <= h.fetched_on AND h.fetched_on < e.until AND e.value <> ''
   AND ((e.kind = 'domain' AND (h.host = e.value OR ends_with(h.host, '.' || e.value) AND NOT regexp_matches(h.host, '{ADDRESS}')))
     OR (e.kind = 'prefix' AND (h.host || '/' || h.path = e.value OR starts_with(h.host || '/' || h.path, e.value || '/'))))
  GROUP BY h.page_id, h.url)
SELECT h.page_id, h.host, CAST(h.fetched_on AS VARCHAR) AS fetched_on, coalesce(hits, 0) AS hits, coalesce(lists, '') AS lists, coalesce(NOT fine, false) AS blocked
FROM h LEFT JOIN hit ON h.page_id = hit.page_id AND h.url = hit.url
"""
