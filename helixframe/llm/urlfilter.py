"""URL filters by a temporal list join.

Dated list entries (add or remove a prefix, host or domain) become validity intervals, and every capture is held
against the entries that were active when it was fetched.  A capture's keys are its host, every suffix of its host
at a dot, and its host with every prefix of its path at a slash; keys meet entries by equality and their
interval by the fetch day, so the work follows the captures and not captures times entries.

On a day with several actions for one entry, an addition wins.  An entry is active from the day of its addition
to the day before its removal; a removal without an addition does nothing.  A capture whose URL is null or has no host, or
whose fetch day is null, matches nothing.  Hosts compare in lower case, without user and port; paths as they are.
Rows that repeat a capture id are one capture each, whatever their URL or day, and repeated entries count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

KINDS = ("prefix", "host", "domain")  # the most specific first
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)"
FOREVER = "9999-12-31"
#: Intervals that are broadcast: some 100 bytes each.
BROADCAST_ENTRIES = 200_000


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, AUTHORITY, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, since, until): days [since, until) on which an entry is active.

    entries: kind, pattern, day (date), action ('add' or 'remove'); other columns are not read, rows with a null
    in these are no entries.  One action a day is left of each entry, so a window holds at most the calendar.
    """
    known = entries.select("kind", "pattern", "day", "action").na.drop().where(F.col("action").isin("add", "remove"))
    daily = known.groupBy("kind", "pattern", "day").agg(F.min("action").alias("action"))  # 'add' sorts first
    order = Window.partitionBy("kind", "pattern").orderBy("day")
    changes = daily.withColumn("before", F.lag("action").over(order)).where(
        F.when(F.col("action") == "add", F.coalesce(F.col("before") != "add", F.lit(True))).otherwise(F.col("before") == "add")
    )
    spans = changes.withColumn("until", F.coalesce(F.lead("day").over(order), F.lit(FOREVER).cast("date")))
    return spans.where("action = 'add'").select("kind", "pattern", F.col("day").alias("since"), "until")


def keys_of(host: Column, path: Column) -> Column:
    """Array of (kind, pattern) that could list a URL; empty without a host."""
    labels, steps = F.split(host, r"\."), F.split(path, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("pattern")),
    )
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    none = F.slice(own, 1, 0)
    return F.when(F.length(host) > 0, F.array_distinct(F.concat(own, suffixes, F.when(F.length(path) > 1, prefixes).otherwise(none)))).otherwise(none)


def matched(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(capture, url, day, n_active, reason, since) of each capture that an active entry lists; reason: the most specific.

    captures: capture, url, day; each distinct row is one capture.  A list of BROADCAST_ENTRIES intervals at most goes
    to every task; with a longer one captures and entries meet by a shuffle, whose skewed keys Spark splits.
    """
    active = cut(intervals(entries))
    if active.count() <= BROADCAST_ENTRIES:
        active = F.broadcast(active)
    keyed = captures.select("capture", "url", "day", F.explode(keys_of(host_of(F.col("url")), path_of(F.col("url")))).alias("k"))
    hits = keyed.select("capture", "url", "day", "k.kind", "k.pattern").join(active, ["kind", "pattern"]).where("since <= day and day < until")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    first = F.min(F.struct(rank, -F.length("pattern"), "pattern", "kind", "since")).alias("first")
    found = hits.groupBy("capture", "url", "day").agg(F.count("*").alias("n_active"), first)
    return found.select("capture", "url", "day", "n_active", F.concat("first.kind", F.lit(":"), "first.pattern").alias("reason"), "first.since")


def filter_captures(captures: DataFrame, entries: DataFrame, key: str, url: str = "url", day: str = "fetch_day") -> DataFrame:
    """(key, host, day, blocked, n_active, reason, since) of each capture."""
    plain = captures.select(F.col(key).alias("capture"), F.col(url).alias("url"), F.col(day).alias("day"))
    found = matched(plain.distinct(), entries)
    out = plain.join(found, ["capture", "url", "day"], "left")
    return out.select(
        F.col("capture").alias(key), F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.col("day").alias(day),
        F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).alias("n_active"), "reason", "since",
    )


def digit(text: Column, place: int) -> Column:
    """A number from 0 to 15 that hangs on a text: a hex digit of its md5."""
    return F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(text), place, 1)) - 1


def dated_list(pages: DataFrame) -> DataFrame:
    """Entries for the registered query, made of the pages' own hosts, domains and first path steps."""
    urls = pages.select(host_of(F.col("url")).alias("host"), F.split(path_of(F.col("url")), "/").alias("steps")).where("host <> ''")
    domain = F.substring_index("host", ".", -3)
    named = (
        urls.select(F.lit("host").alias("kind"), F.col("host").alias("pattern"), F.lit(9).alias("least"))
        .unionByName(urls.select(F.lit("domain").alias("kind"), domain.alias("pattern"), F.lit(4).alias("least")))
        .unionByName(urls.where("size(steps) > 1").select(F.lit("prefix").alias("kind"), F.concat("host", F.lit("/"), F.col("steps")[1]).alias("pattern"), F.lit(5).alias("least")))
        .distinct()
    )
    name = F.concat("kind", F.lit(":"), "pattern")
    added = digit(name, 2) * 8
    removed = added + 30 + digit(name, 4) * 8
    again = removed + 20 + digit(name, 6) * 8
    listed = named.where(digit(name, 1) < F.col("least"))
    events = [
        (F.lit(True), added, "add"),
        (digit(name, 3) < 10, removed, "remove"),
        ((digit(name, 3) < 10) & (digit(name, 5) < 8), again, "add"),
    ]
    made = [listed.where(when).select("kind", "pattern", F.date_add(F.lit("2023-01-01").cast("date"), day.cast("int")).alias("day"), F.lit(action).alias("action")) for when, day, action in events]
    return made[0].unionByName(made[1]).unionByName(made[2])


def op2_url_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    key = F.concat(F.lit("fetch:"), F.col("page_id").cast("string"))
    day = F.date_add(F.lit("2023-01-01").cast("date"), (digit(key, 1) * 16 + digit(key, 2)).cast("int"))
    return filter_captures(pages.withColumn("fetch_day", day), dated_list(pages), "page_id")


ORACLE = r"""
WITH p AS (
  SELECT page_id, url,
    coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '') AS host,
    coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1), '') AS path,
    DATE '2023-01-01' + ((instr('0123456789abcdef', substr(md5('fetch:' || page_id), 1, 1)) - 1) * 16
      + instr('0123456789abcdef', substr(md5('fetch:' || page_id), 2, 1)) - 1)::INT AS fetch_day
  FROM pages),
named AS (
  SELECT DISTINCT 'host' AS kind, host AS pattern, 9 AS least FROM p WHERE host <> ''
  UNION SELECT DISTINCT 'domain', array_to_string(list_slice(string_split(host, '.'), greatest(1, len(string_split(host, '.')) - 2), len(string_split(host, '.'))), '.'), 4 FROM p WHERE host <> ''
  UNION SELECT DISTINCT 'prefix', host || '/' || string_split(path, '/')[2], 5 FROM p WHERE host <> '' AND len(string_split(path, '/')) > 1),
digits AS (
  SELECT kind, pattern, least, list_transform(range(1, 7), lambda i: instr('0123456789abcdef', substr(md5(kind || ':' || pattern), i::INT, 1)) - 1) AS d FROM named),
listed AS (
  SELECT kind, pattern, d, d[2] * 8 AS added, d[2] * 8 + 30 + d[4] * 8 AS removed, d[2] * 8 + 30 + d[4] * 8 + 20 + d[6] * 8 AS again FROM digits WHERE d[1] < least),
active AS (
  SELECT kind, pattern, DATE '2023-01-01' + added::INT AS since, CASE WHEN d[3] < 10 THEN DATE '2023-01-01' + removed::INT ELSE DATE '9999-12-31' END AS until FROM listed
  UNION ALL SELECT kind, pattern, DATE '2023-01-01' + again::INT, DATE '9999-12-31' FROM listed WHERE d[3] < 10 AND d[5] < 8),
keyed AS (
  SELECT page_id, url, fetch_day, 1 AS rank, 'prefix' AS kind, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: host || array_to_string(list_slice(string_split(path, '/'), 1, i), '/'))) AS pattern FROM p WHERE host <> '' AND length(path) > 1
  UNION ALL SELECT page_id, url, fetch_day, 2, 'host', host FROM p WHERE host <> ''
  UNION ALL SELECT page_id, url, fetch_day, 3, 'domain', unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'))) FROM p WHERE host <> ''),
hits AS (SELECT DISTINCT k.page_id, k.url, k.rank, k.kind, k.pattern, a.since FROM keyed k JOIN active a ON k.kind = a.kind AND k.pattern = a.pattern AND a.since <= k.fetch_day AND k.fetch_day < a.until),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY rank, length(pattern) DESC, pattern) AS rn, count(*) OVER (PARTITION BY page_id, url) AS n FROM hits)
SELECT p.page_id, p.host, p.fetch_day, b.page_id IS NOT NULL AS blocked, coalesce(b.n, 0)::BIGINT AS n_active,
  b.kind || ':' || b.pattern AS reason, b.since
FROM p LEFT JOIN best b ON p.page_id = b.page_id AND p.url = b.url AND b.rn = 1
"""
