"""URL filtering against dated lists, with DataFrame functions only.

Entries of a list say that from a time on a rule blocks, allows or no longer counts. ``validity`` turns them into
intervals: an entry holds until the next one of its rule. A rule is a domain, which covers its subdomains, or a host with
a path prefix of whole segments. ``evaluate`` gives every capture the rules of its URL with their dated intervals and
picks, as of the fetch time, the most specific rule that is active: a path before a domain, then the longer one.

A capture meets the rules by the keys its URL could be listed under. Captures and intervals of a rule are then joined as
of the fetch time: they stand in one list, in which the last interval is carried forward. Neither a busy host nor a rule
that changed often multiplies rows, and the list of a busy rule is cut by time.

Defined results: a null or malformed URL, or a null fetch time, is decided ``none``; entries with a null rule or time
don't count; of several entries of a rule at one time the last action by name holds; an interval includes its start and
excludes its end; repeated captures keep a row each; empty tables give no rows or no decisions; other columns of the
captures pass through, whatever their names (decision, rule and listed_at are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import unused, written


def host_of(url: Column) -> Column:
    """The host in lower case without user, port and final dot; empty if the URL has none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """Everything the URL could be listed under: its host and parent domains, and the host with each path prefix."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    prefixes = F.when(F.size(segments) > 0, F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/"))))
    return F.when(host != "", F.concat(domains, F.coalesce(prefixes, F.array().cast("array<string>"))))


def validity(entries: DataFrame) -> DataFrame:
    """rule, action, valid_from, valid_to of (rule, action, listed_at): actions block and allow; others end a rule."""
    own = entries.where("rule is not null and listed_at is not null and action is not null").groupBy("rule", "listed_at").agg(F.max("action").alias("action"))
    following = F.lead("listed_at").over(Window.partitionBy("rule").orderBy("listed_at"))
    return own.withColumn("valid_to", following).where(F.col("action").isin("block", "allow")).select("rule", "action", F.col("listed_at").alias("valid_from"), "valid_to")


#: A rule with more requests than this, and than one in BUSY of all (so there are at most BUSY), is cut by time in CUTS.
STRETCH, BUSY, CUTS = 1000, 10_000, 64


def evaluate(captures: DataFrame, intervals: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """``captures`` with decision (block, allow or none), rule and listed_at (null for none)."""
    base = captures.drop("decision", "rule", "listed_at")
    address, moment, best = unused(base, "asked_url", "asked_at", "best")
    rows = base.withColumn(address, F.col(url)).withColumn(moment, F.col(fetched_at))
    # A URL that was fetched at one time is asked about once; only keys that some rule has go on.
    asked = rows.select(F.col(address).alias("u"), F.col(moment).alias("at")).where("u is not null and at is not null").distinct()
    keys = asked.select("u").distinct().select("u", F.explode(keys_of(F.col("u"))).alias("rule")).distinct()
    listed = keys.join(intervals.select("rule").distinct(), "rule")
    known = as_of(written(asked.join(listed, "u").select("rule", "at", "u"), "requests"), intervals)
    ranked = F.struct(F.contains("rule", F.lit("/")).alias("path"), F.length("rule").alias("n"), "rule", "action", "valid_from")
    # The most specific rule of each request: a running maximum before rows are shuffled.
    decided = known.groupBy("u", "at").agg(F.max(ranked).alias(best)).withColumnsRenamed({"u": address, "at": moment})
    joined = rows.join(decided, [address, moment], "left")
    return joined.select(*base.columns, F.coalesce(F.col(f"{best}.action"), F.lit("none")).alias("decision"), F.col(f"{best}.rule").alias("rule"), F.col(f"{best}.valid_from").alias("listed_at"))


def as_of(requests: DataFrame, intervals: DataFrame) -> DataFrame:
    """rule, at, u, action, valid_from of the requests (rule, at, u) that an interval of their rule covers.

    Intervals and requests of a rule stand in one list by time, and the last interval before a request is carried to it.
    The list of a busy rule is cut into stretches of time with about equal numbers of requests; each begins with the
    interval that was open there, so no task holds a rule.
    """
    counts = requests.groupBy("rule").agg(F.count("*").alias("n")).where(F.col("n") > max(STRETCH, requests.count() // BUSY)).select("rule")
    at = F.percentile_approx("at", F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)]), 1000)
    busy = requests.join(F.broadcast(counts), "rule", "left_semi").groupBy("rule").agg(F.array_distinct(at).alias("cuts"))
    stretch = lambda t: F.coalesce(F.size(F.filter("cuts", lambda c: c <= t)), F.lit(0))
    asks = requests.join(F.broadcast(busy), "rule", "left").select("rule", stretch(F.col("at")).alias("part"), F.col("at").alias("time"), F.lit(1).alias("side"), "u", F.lit(None).cast(_held(intervals)).alias("held"))
    held = F.struct("valid_from", "valid_to", "action")
    # An interval is in the stretch it begins in and in every later one until it ends.
    spans = intervals.join(F.broadcast(busy), "rule", "left").withColumn("first", stretch(F.col("valid_from"))).withColumn("last", F.when(F.col("valid_to").isNull(), F.coalesce(F.size("cuts"), F.lit(0))).otherwise(stretch(F.col("valid_to"))))
    starts = spans.select("rule", F.explode(F.sequence("first", "last")).alias("part"), F.col("valid_from").alias("time"), F.lit(0).alias("side"), F.lit(None).cast("string").alias("u"), held.alias("held"))
    upto = Window.partitionBy("rule", "part").orderBy("time", "side").rowsBetween(Window.unboundedPreceding, 0)
    carried = asks.unionByName(starts).withColumn("now", F.last("held", ignorenulls=True).over(upto))
    open_now = F.col("now").isNotNull() & (F.col("now.valid_to").isNull() | (F.col("time") < F.col("now.valid_to")))
    return carried.where((F.col("side") == 1) & open_now).select("rule", F.col("time").alias("at"), "u", "now.action", "now.valid_from")


def _held(intervals: DataFrame) -> str:
    kind = intervals.schema["valid_from"].dataType.simpleString()
    return f"struct<valid_from: {kind}, valid_to: {kind}, action: string>"


#: The list of the query: a host or its domain of three labels, by the first hexadecimal digits of its MD5, is blocked or
#: allowed from a day of 2024 on, taken off the list some weeks later and, for some, listed again; a path prefix likewise.
FIRST_DAY = "2024-01-01"


def _entries(pages: DataFrame) -> DataFrame:
    url = F.col("url")
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    segment = F.get(F.filter(F.split(path_of(url), "/"), lambda s: s != ""), F.lit(0))
    domain = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 2), F.lit(3)), ".")
    named = pages.where(host != "").select(F.explode(F.array(host, domain, F.when(segment.isNotNull(), F.concat(host, F.lit("/"), segment)))).alias("rule")).where("rule is not null").distinct()
    x = F.conv(F.substring(F.md5(F.col("rule").cast("binary")), 1, 6), 16, 10).cast("long")
    start = x % 400
    turns = F.array(
        F.struct(start.alias("day"), F.when(x % 3 == 0, F.lit("allow")).otherwise(F.lit("block")).alias("action")),
        F.struct((start + 40 + x % 90).alias("day"), F.lit("remove").alias("action")),
        F.struct((start + 160 + x % 60).alias("day"), F.when(x % 2 == 0, F.lit("block")).otherwise(F.lit("remove")).alias("action")),
    )
    listed = named.where(x % 4 != 0).select("rule", F.explode(turns).alias("t"))
    return listed.select("rule", F.col("t.action").alias("action"), F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("t.day").cast("int")).alias("listed_at"))


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the decision of the dated list on the day of its capture (page_id counts days over two years)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod("page_id", F.lit(730)).cast("int")))
    return evaluate(captures, validity(_entries(pages)))


ORACLE = r"""
with p as (
  select page_id, url, date '2024-01-01' + cast(page_id % 730 as integer) as fetched_at,
    lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')) as host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') as segs
  from pages
), named as (
  select host as rule from p where host <> ''
  union select array_to_string(list_slice(string_split(host, '.'), greatest(1, len(string_split(host, '.')) - 2), len(string_split(host, '.'))), '.') from p where host <> ''
  union select host || '/' || segs[1] from p where host <> '' and len(segs) > 0
), x as (
  select rule, cast('0x' || md5(rule)[1:6] as bigint) as x from named
), entries as (
  select rule, case when x % 3 = 0 then 'allow' else 'block' end as action, x % 400 as day from x where x % 4 <> 0
  union all select rule, 'remove', x % 400 + 40 + x % 90 from x where x % 4 <> 0
  union all select rule, case when x % 2 = 0 then 'block' else 'remove' end, x % 400 + 160 + x % 60 from x where x % 4 <> 0
), own as (
  select rule, date '2024-01-01' + cast(day as integer) as listed_at, max(action) as action from entries group by rule, day
), v as (
  select *, lead(listed_at) over (partition by rule order by listed_at) as valid_to from own
), m as (
  select p.page_id, p.url, p.fetched_at, v.rule, v.action, v.listed_at,
    row_number() over (partition by p.page_id, p.url order by contains(v.rule, '/') desc, length(v.rule) desc) as n
  from p join v on v.action in ('block', 'allow') and v.listed_at <= p.fetched_at and (v.valid_to is null or p.fetched_at < v.valid_to)
    and (p.host = v.rule or ends_with(p.host, '.' || v.rule) or v.rule = p.host || '/' || p.segs[1])
)
select p.page_id, p.url, p.fetched_at, coalesce(m.action, 'none') as decision, m.rule, m.listed_at
from p left join m on p.page_id = m.page_id and m.n = 1
"""
