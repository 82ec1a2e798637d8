"""URL filters as a temporal list join.

A list is a log of dated entries: key, action ``add`` or ``remove``, and the time from which it holds.
Each key's entries become validity intervals [valid_from, valid_to). Every capture (a URL and when it
was fetched) is looked up under its host, each parent domain and host + path prefixes by an equi-join,
and the as-of condition keeps the entry that was active at fetch time; of several the most specific,
that is the longest key, decides.

The list side is narrow, and Spark broadcasts it where its measured size allows; else both sides
shuffle by key, where adaptive execution splits hosts that hold a large part of all rows. A capture has a
key for each label of its host and each segment of its path up to the list's deepest entry, and at most
one interval of a key covers its fetch time. What is decided depends on URL and fetch time only, so each
distinct pair is looked up once and no row needs a number of its own.

Defined cases: a null or empty URL, or one without a host, is allowed; a null fetch time meets no
interval and is allowed; entries with null key, action or time are left out; entries of one key at
the same time: ``remove`` wins; an empty list blocks nothing; very long URLs are looked up like others;
repeated rows of captures give repeated rows; columns of captures may have any name but the three of the
result (blocked, matched_key, category).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Dated entries of the registered query's list, fixed values; ``site_entries`` adds to them by rule.
ENTRIES = (
    ("www.cheap-pills.example.com", "add", "2024-01-01", "spam"),
    ("cheap-pills.example.com", "add", "2024-02-15", "spam"),
    ("cheap-pills.example.com", "remove", "2024-09-01", "spam"),
    ("www.cheap-pills.example.com", "remove", "2024-06-01", "spam"),
    ("www.cheap-pills.example.com", "add", "2024-08-01", "spam"),
    ("example.net", "add", "2024-03-10", "maintenance"),
    ("example.net", "remove", "2024-03-20", "maintenance"),
    ("tionsh.example.net", "add", "2024-05-01", "mirror"),
    ("tionsh.example.net/en", "add", "2024-07-01", "mirror"),
    ("blog.tionsh.example.net", "add", "2024-04-01", "mirror"),
    ("therha.example.com", "add", "2024-10-01", "abuse"),
    ("m.ththth.example.net/en", "add", "2024-01-15", "abuse"),
    ("ththre.example.com/fr", "add", "2024-11-01", "abuse"),
    ("ththre.example.com/fr", "remove", "2024-12-01", "abuse"),
)


SITE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@:]+)(?:/([^/?#]+/[^/?#]+))?"


def entries(spark: SparkSession) -> DataFrame:
    """The fixed list as key, action, at, category."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(e, ("key", "action", "at", "category"), strict=True)]) for e in ENTRIES])
    return spark.range(1).select(F.explode(rows).alias("e")).select("e.key", "e.action", F.to_timestamp("e.at").alias("at"), "e.category")


def site_entries(pages: DataFrame) -> DataFrame:
    """key, action, at, category by rule from the sites of ``pages``, so that the query's list grows with its input.

    Of the hosts, and of the hosts with their first two path segments, those whose MD5 starts with 0 to 2 are
    added on the first of a month that its second digit gives; a third digit under 8 removes them four
    months later, if that is in the year.
    """
    url = F.coalesce("url", F.lit(""))
    site = pages.select(F.lower(F.regexp_extract(url, SITE, 1)).alias("host"), F.regexp_extract(url, SITE, 2).alias("path")).where("host <> ''")
    keys = site.select(F.explode(F.array(F.col("host"), F.when(F.col("path") != "", F.concat("host", F.lit("/"), "path")))).alias("key")).where("key is not null").distinct()
    digit = lambda k: F.conv(F.substring(F.md5("key"), k, 1), 16, 10).cast("int")
    listed = keys.where(F.substring(F.md5("key"), 1, 1).isin("0", "1", "2")).withColumn("month", digit(2) % 12 + 1)
    at = lambda m: F.to_timestamp(F.format_string("2024-%02d-01", m))
    one = lambda action, m: F.struct(F.lit(action).alias("action"), at(m).alias("at"))
    gone = F.when((digit(3) < 8) & (F.col("month") <= 8), one("remove", F.col("month") + 4))
    each = listed.select("key", F.explode(F.array_compact(F.array(one("add", F.col("month")), gone))).alias("e"))
    return each.select("key", "e.action", "e.at", F.lit("listed").alias("category"))


def intervals(log: DataFrame) -> DataFrame:
    """key, category, valid_from, valid_to (null: still valid) of each stretch in which a key is listed."""
    fit = log.where(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove"))
    one = fit.groupBy("key", "at").agg(F.max("action").alias("action"), F.min("category").alias("category"))
    follow = Window.partitionBy("key").orderBy("at")
    return (
        one.withColumn("valid_to", F.lead("at").over(follow))
        .where("action = 'add'")
        .select("key", "category", F.col("at").alias("valid_from"), "valid_to")
    )


def keys_of(url: F.Column, depth: F.Column) -> F.Column:
    """Host, parent domains and host + path prefixes of up to ``depth`` segments of a URL, lower-cased host, no port or credentials."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    labels, segments = F.split(host, r"\."), F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(1), depth)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    under = F.when(F.size(segments) > 0, F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/"))))
    none = F.array().cast("array<string>")
    return F.when(host == "", none).otherwise(F.array_distinct(F.concat(parents, F.coalesce(under, none))))


def filter_urls(captures: DataFrame, log: DataFrame, *, keep: tuple[str, ...] = ("page_id", "url", "fetched_at")) -> DataFrame:
    """``keep`` and blocked, matched_key, category of every capture (url, fetched_at)."""
    listed = intervals(log)
    # One row: how many path segments the deepest entry has.
    deepest = listed.agg(F.coalesce(F.max(F.size(F.split("key", "/")) - 1), F.lit(0)).alias("depth"))
    asked = captures.select(F.col("url").alias("u"), F.col("fetched_at").alias("t")).where("u is not null and t is not null").distinct()
    looked = asked.crossJoin(F.broadcast(deepest)).select("u", "t", F.explode(keys_of(F.col("u"), F.col("depth"))).alias("key"))
    active = (F.col("t") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to")))
    longest = F.struct(F.char_length("key").alias("size"), F.col("key"), F.col("category"))
    # Only captures with an active entry are summed.
    hit = looked.join(listed, "key").where(active).groupBy("u", "t").agg(F.max(longest).alias("m"))
    rows = captures.select(F.struct(*keep).alias("row"))
    out = rows.join(hit, (rows["row.url"] == hit["u"]) & (rows["row.fetched_at"] == hit["t"]), "left")
    return out.select("row.*", F.col("m").isNotNull().alias("blocked"), F.col("m.key").alias("matched_key"), F.col("m.category").alias("category"))


def fetched(pages: DataFrame) -> DataFrame:
    """``pages`` have no fetch time; the query gives them one from the id: the id's day of 2024, at noon."""
    at = F.timestamp_seconds(F.lit(1704067200 + 43200) + F.pmod(F.col("page_id"), F.lit(366)) * 86400)
    return pages.withColumn("fetched_at", at)


_VALUES = ", ".join(f"('{k}', '{a}', TIMESTAMP '{t} 00:00:00', '{c}')" for k, a, t, c in ENTRIES)
_SITE = SITE.replace("'", "''")
ORACLE = f"""
WITH site AS (SELECT lower(regexp_extract(coalesce(url, ''), '{_SITE}', 1)) AS host, regexp_extract(coalesce(url, ''), '{_SITE}', 2) AS path FROM pages),
ks AS (SELECT host AS key FROM site WHERE host <> '' UNION SELECT host || '/' || path FROM site WHERE host <> '' AND path <> ''),
mk AS (SELECT key, CAST(('0x' || substr(md5(key), 2, 1)) AS INTEGER) % 12 + 1 AS m, substr(md5(key), 3, 1) < '8' AS goes FROM ks WHERE substr(md5(key), 1, 1) IN ('0', '1', '2')),
log AS (SELECT * FROM (VALUES {_VALUES}) AS v(key, action, since, category)
        UNION ALL SELECT key, 'add', make_timestamp(2024, m, 1, 0, 0, 0), 'listed' FROM mk UNION ALL SELECT key, 'remove', make_timestamp(2024, m + 4, 1, 0, 0, 0), 'listed' FROM mk WHERE goes AND m <= 8),
one AS (SELECT key, since, max(action) AS action, min(category) AS category FROM log GROUP BY key, since),
listed AS (SELECT * FROM (SELECT key, category, action, since AS valid_from, lead(since) OVER (PARTITION BY key ORDER BY since) AS valid_to FROM one) WHERE action = 'add'),
p AS (SELECT row_number() OVER () AS r, page_id, url, TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST(page_id % 366 AS INTEGER)) AS fetched_at,
        lower(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')) AS host,
        list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'), lambda x: x <> '') AS seg FROM pages),
k AS (SELECT r, fetched_at, unnest(list_distinct(list_concat(
        list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
        list_transform(range(1, len(seg) + 1), lambda i: host || '/' || array_to_string(seg[1:i], '/'))))) AS key FROM p WHERE host <> ''),
hit AS (SELECT r, key, category, row_number() OVER (PARTITION BY r ORDER BY length(key) DESC, key DESC, category DESC) AS n
        FROM k JOIN listed USING (key) WHERE fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to))
SELECT page_id, url, CAST(fetched_at AS TIMESTAMP) AS fetched_at, hit.key IS NOT NULL AS blocked, hit.key AS matched_key, hit.category AS category
FROM p LEFT JOIN hit ON p.r = hit.r AND hit.n = 1
"""
