"""URL filters as a temporal list join.

A list is a table of dated entries: (list, key, action, day), where a key is a host or domain, or a host with a path
prefix, and an action adds or removes it. In order of days, each added entry becomes the validity interval from its
day to the day of the next entry of the same list and key. A capture has a few keys: every domain that its host ends
in, and every path prefix under its host. It is filtered when an interval of one of its keys holds its fetch day: an
as-of join, by equality of keys and then by the interval.

A verdict depends on a capture's URL and day alone, so it is sought once for each distinct pair of them, and captures
take it over by an equality join on that pair: no row numbers are drawn, which a repeated or re-planned task could draw
differently. Intervals go to all executors if there are at most ``SENT`` of them; beyond that the join is a shuffle by
key, whose large partitions Spark splits, since a hot host is many captures but few intervals. Hits are summed up by
pair before and after the shuffle.

Cases. Captures without a match stay: one row per capture, repeated captures judged alike, none merged. On one day,
removals come after additions (ties). A null or unreadable URL has no host and no keys and is never filtered; so is a
capture without a day, and an empty URL. Entries without key, list, action or day are no entries; repeated entries count
once. A URL of any length has one key for each path prefix, so its keys grow with the square of its depth. Empty captures
give an empty result, empty lists filter nothing. Columns may have any names: they travel in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bind, hash60, written

SENT = 100_000
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def keys_of(url: Column) -> Column:
    """Every domain of two or more labels that the host ends in, and the host with every path prefix."""

    def domains(labels: Column) -> Column:
        tail = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
        return F.when(F.size(labels) >= 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), tail)).otherwise(F.array().cast("array<string>"))

    def paths(parts: Column) -> Column:
        head = lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))
        return F.when((F.size(parts) >= 1) & (host_of(url) != ""), F.transform(F.sequence(F.lit(1), F.size(parts)), head)).otherwise(F.array().cast("array<string>"))

    segments = F.array_remove(F.split(F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit("")), "/"), "")
    return F.array_distinct(F.concat(bind(F.split(host_of(url), r"\."), domains), bind(segments, paths)))


def intervals(entries: DataFrame) -> DataFrame:
    """list, key, since, until (null: to this day) of (list, key, action, day) entries."""
    rows = entries.where("list is not null and key is not null and day is not null and action in ('add', 'remove')").select("list", "key", "action", "day").distinct()
    order = Window.partitionBy("list", "key").orderBy("day", "action")
    rows = rows.withColumn("until", F.lead("day").over(order))
    return rows.where("action = 'add' and (until is null or until > day)").select("list", "key", F.col("day").alias("since"), "until")


def verdicts(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """(u, on, n_entries, first_list, since) of the distinct URLs and days of (u, on) that an active entry filters."""
    valid = written(intervals(entries), "url-intervals")
    valid = F.broadcast(valid) if valid.limit(SENT + 1).count() <= SENT else valid
    slim = pairs.where("u is not null and on is not null").distinct().select("u", "on", F.explode(keys_of(F.col("u"))).alias("key"))
    active = (F.col("since") <= F.col("on")) & (F.col("until").isNull() | (F.col("on") < F.col("until")))
    hits = slim.join(valid, "key").where(active)
    return hits.groupBy("u", "on").agg(F.count(F.lit(1)).alias("n_entries"), F.min("list").alias("first_list"), F.min("since").alias("since"))


def judged(captures: DataFrame, entries: DataFrame, *, url="url", day="day") -> DataFrame:
    """(row, host, filtered, n_entries, first_list, since) of every capture; row has all its columns."""
    rows = captures.select(F.struct(*[F.col(c) for c in captures.columns]).alias("row"), F.col(url).alias("u"), F.col(day).alias("on"))
    found = verdicts(rows.select("u", "on"), entries)
    out = rows.join(found, ["u", "on"], "left")
    return out.select("row", host_of(F.col("u")).alias("host"), F.col("n_entries").isNotNull().alias("filtered"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), "first_list", "since")


def passed(captures: DataFrame, entries: DataFrame, **options) -> DataFrame:
    """The captures that no active entry filters, with all their columns."""
    return judged(captures, entries, **options).where("not filtered").select("row.*")


def fetch_day(url: Column) -> Column:
    """A day of 2024 for pages that carry none, drawn from the URL."""
    return F.date_add(F.lit("2024-01-01").cast("date"), (hash60(F.concat(F.lit("fetch:"), url)) % 366).cast("int"))


def drawn_entries(pages: DataFrame, url: str = "url") -> DataFrame:
    """A list for tables without one: a third of all hosts are added on some day, half of these removed again, a quarter
    added again; a fifth of their parent domains; and some first path segments."""
    hosts = pages.select(host_of(F.col(url)).alias("host")).where("host != ''").distinct()
    hosts = hosts.withColumn("h", hash60(F.concat(F.lit("list:"), F.col("host"))))
    start = F.lit("2024-01-01").cast("date")
    first = F.date_add(start, ((F.col("h") / 64).cast("long") % 200).cast("int"))
    entry = lambda rows, name, key, action, day: rows.select(F.lit(name).alias("list"), key.alias("key"), F.lit(action).alias("action"), day.alias("day"))
    host = F.col("host")
    out = entry(hosts.where("h % 3 = 0"), "hosts", host, "add", first)
    out = out.unionByName(entry(hosts.where("h % 6 = 0"), "hosts", host, "remove", F.date_add(first, 40)))
    out = out.unionByName(entry(hosts.where("h % 12 = 0"), "hosts", host, "add", F.date_add(first, 100)))
    parents = hosts.where("size(split(host, '[.]')) >= 4 and h % 5 = 0").select(F.expr("substring_index(host, '.', -3)").alias("host"), "h")
    out = out.unionByName(entry(parents, "domains", host, "add", F.date_add(first, 90)))
    return out.unionByName(entry(hosts.where("h % 7 = 0"), "paths", F.concat(host, F.lit("/en")), "add", F.date_add(first, 10)))


_SQL_HOST = "lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_SQL_HASH = "CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"
SQL = f"""
WITH p AS (SELECT page_id, url, row_number() OVER () AS uid, {_SQL_HOST} AS host,
  CAST(DATE '2024-01-01' + CAST({_SQL_HASH.format(x="'fetch:' || url")} % 366 AS INTEGER) AS DATE) AS on_day,
  list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS seg FROM pages),
k0 AS (SELECT uid, on_day, host, string_split(host, '.') AS l, seg FROM p),
k AS (SELECT DISTINCT uid, on_day, array_to_string(l[i:], '.') AS key FROM k0, range(1, 1000) r(i) WHERE i < len(l)
  UNION SELECT uid, on_day, host || '/' || array_to_string(seg[1:i], '/') FROM k0, range(1, 1000) r(i) WHERE i <= len(seg) AND host <> ''),
h AS (SELECT host, {_SQL_HASH.format(x="'list:' || host")} AS h FROM (SELECT DISTINCT host FROM p WHERE host <> '')),
f AS (SELECT *, CAST(DATE '2024-01-01' + CAST(CAST(floor(CAST(h AS DOUBLE) / 64) AS BIGINT) % 200 AS INTEGER) AS DATE) AS d FROM h),
e AS (SELECT 'hosts' AS list, host AS key, 'add' AS action, d AS day FROM f WHERE h % 3 = 0
  UNION SELECT 'hosts', host, 'remove', CAST(d + 40 AS DATE) FROM f WHERE h % 6 = 0
  UNION SELECT 'hosts', host, 'add', CAST(d + 100 AS DATE) FROM f WHERE h % 12 = 0
  UNION SELECT 'domains', array_to_string(string_split(host, '.')[-3:], '.'), 'add', CAST(d + 90 AS DATE) FROM f WHERE len(string_split(host, '.')) >= 4 AND h % 5 = 0
  UNION SELECT 'paths', host || '/en', 'add', CAST(d + 10 AS DATE) FROM f WHERE h % 7 = 0),
v0 AS (SELECT *, lead(day) OVER (PARTITION BY list, key ORDER BY day, action) AS until FROM e),
v AS (SELECT list, key, day AS since, until FROM v0 WHERE action = 'add' AND (until IS NULL OR until > day)),
m AS (SELECT uid, CAST(count(*) AS BIGINT) AS n, min(list) AS first_list, min(since) AS since FROM k JOIN v USING (key) WHERE since <= on_day AND (until IS NULL OR on_day < until) GROUP BY uid)
SELECT page_id, host, on_day AS fetched_on, m.n IS NOT NULL AS filtered, coalesce(m.n, 0) AS n_entries, m.first_list, m.since FROM p LEFT JOIN m USING (uid)
"""
