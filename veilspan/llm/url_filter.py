"""URL rules by a sort-merge range join: reversed hosts turn rules into nested intervals, a sorted sweep keeps their stack."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys sampled, about, to place the bounds between buckets; they affect balance only.
SAMPLE = 4096
#: Rules of one host that rows hold against their path one by one; more are swept by path.
HELD = 32


def url_host(url: Column) -> Column:
    """What follows the first :// up to /, ? or #, A-Z lower-cased; empty if the url is null or lacks ://."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def host_key(host: Column) -> Column:
    """Labels from the right, each ended by a dot: a host and its subdomains are the keys that begin with its key."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]", -1)), "."), F.lit("."))


def _stacks(keys: DataFrame, own: DataFrame) -> DataFrame:
    """(key, stack, wide): the rules whose interval holds the key, longest first, and the hosts whose rules are too many for a stack."""
    labels = F.split("key", "[.]", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    held = keys.select("key", F.explode(prefixes).alias("prefix")).join(own, F.col("prefix") == F.col("r_key"), "left")
    both = held.groupBy("key").agg(F.flatten(F.collect_list("few")).alias("stack"), F.sort_array(F.collect_list("many")).alias("wide"))
    return both.select("key", F.reverse(F.array_sort("stack")).alias("stack"), "wide")


def _below(bounds: Sequence[str], key: Column, equal: bool) -> Column:
    """How many of the sorted bounds lie below the key (or equal it), by halving."""
    if not bounds:
        return F.lit(0)
    listed = F.array(*[F.lit(b) for b in bounds])

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        at = F.get(listed, mid)
        right = (acc["lo"] < acc["hi"]) & ((at <= key) if equal else (at < key))
        lo = F.when(right, mid + 1).otherwise(acc["lo"])
        return F.struct(lo.alias("lo"), F.when(right, acc["hi"]).otherwise(F.when(acc["lo"] < acc["hi"], mid).otherwise(acc["hi"])).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(len(bounds) + 1)) + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), step, lambda acc: acc["lo"])


def _bounds(keys: DataFrame, n: int) -> list:
    """n - 1 bounds between buckets, from a sample of the keys in column key."""
    share = SAMPLE / max(1, keys.count())
    sample = sorted(r[0] for r in keys.where(F.col("key").isNotNull() & (F.rand(7) < share)).select("key").collect())
    return [sample[len(sample) * i // n] for i in range(1, n)] if sample else []


def _nested(hosts: DataFrame) -> int:
    """How many of the hosts lie above one another, at most; 0 if there are none."""
    found = _stacks(hosts.select(F.col("r_key").alias("key")), hosts.withColumn("few", F.array().cast("array<int>")))
    return found.agg(F.max(F.size("wide"))).first()[0] or 0


def _past(key: Column) -> Column:
    """The least bytes above everything that begins with the key: its last byte plus one."""
    digits = F.hex(key)
    last = F.conv(F.right(digits, F.lit(2)), 16, 10).cast("long") + 1
    return F.unhex(F.concat(F.left(digits, F.length(digits) - 2), F.lpad(F.hex(last), 2, "0")))


def _with_longest_path(rows: DataFrame, rules: DataFrame, at: Column, n: int) -> DataFrame:
    """rows with ``best`` raised to the longest rule of the host key ``at`` whose path begins their own, for hosts of very many rules.

    Paths of a host are prefixes as well, so each rule is an interval of keys, and intervals nest.  In a sorted sweep the number of
    open ones is the height of the stack, and what lies on top at a height is the last rule opened there.  A rule stands in each
    bucket that its interval meets, which are more than one only for the rules around a bound.
    """
    key = lambda host, path: F.concat(host, F.lit("/"), path).cast("binary")
    asked = rows.withColumn("key", key(at, F.col("path")))
    spans = rules.groupBy("r_key", "rule.r_path").agg(F.max("rule").alias("opened")).withColumn("key", key(F.col("r_key"), F.col("r_path"))).withColumn("past", _past(F.col("key")))
    bounds = [bytearray(b) for b in _bounds(asked.select("key").unionByName(spans.select("key")), n)]
    lowest, highest = _below(bounds, F.col("key"), False), _below(bounds, F.col("key"), True)
    last = _below(bounds, F.col("past"), False)
    opens = spans.select("key", F.lit(1).alias("kind"), "opened", F.explode(F.sequence(lowest, last)).alias("bucket"))
    closes = spans.select(F.col("past").alias("key"), F.lit(0).alias("kind"), last.alias("bucket"))
    spread = F.when(F.col("key").isNull(), F.floor(F.rand(13) * n)).otherwise(lowest + F.floor(F.rand(11) * (highest - lowest + 1))).cast("int")
    both = asked.withColumn("kind", F.lit(2)).withColumn("bucket", spread).unionByName(opens, allowMissingColumns=True).unionByName(closes, allowMissingColumns=True)
    sweep = Window.partitionBy("bucket").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("kind") == 1, 1).when(F.col("kind") == 0, -1).otherwise(0)
    level = Window.partitionBy("bucket", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("height", F.sum(step).over(sweep)).withColumn("top", F.last("opened", ignorenulls=True).over(level)).where("kind = 2")
    found = F.when(F.col("height") > 0, F.col("top"))
    return swept.withColumn("best", F.greatest("best", found)).select(*rows.columns)


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, url_col: str = "url", default: str = "allow", buckets: int | None = None, held: int = HELD) -> DataFrame:
    """Adds host, path, rule and verdict to every row.

    A rule (verdict, host, path) fits its host and all subdomains if the url's path starts with the rule's; of those
    that fit, the longest host and path together win, then the longer host; without any, rule is null and the verdict is
    ``default``.  Null urls and urls without :// have an empty host and path.  Rows and boundaries of the rules' intervals
    are sorted together, bucket by bucket; at each boundary stands the stack of rules that are active from there on,
    and a row takes the last stack before it.  Bounds are drawn from a sample of the rows' own keys: one that takes
    many rows occurs often among them, and its rows are spread over as many buckets.  Hosts with more than ``held`` rules stand in
    the stack as one name; rows below them are swept once more, by path (once for each such host above another).  Columns of pages that are named
    host, path, rule or verdict are replaced.  Repeated rows are each judged, urls of any length are read whole.  An empty table gives
    an empty result.
    """
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    name = F.concat("host", "path")
    entry = F.struct(F.length(name).alias("length"), F.length("host").alias("host_length"), name.alias("rule"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    rules = rules.where(F.col("host").isNotNull() & (F.col("path").startswith("/") | (F.col("path") == ""))).select(host_key(F.col("host")).alias("r_key"), entry.alias("rule"))
    sizes = rules.groupBy("r_key").agg(F.count(F.lit(1)).alias("rules"))
    few = rules.join(sizes.where(F.col("rules") <= held), "r_key").groupBy("r_key").agg(F.collect_list("rule").alias("few"))
    many = sizes.where(F.col("rules") > held).select("r_key", F.col("r_key").alias("many"))
    own = few.unionByName(many, allowMissingColumns=True)
    rest = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    urls = pages.select(F.struct(*rest).alias("page"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")).withColumn("key", host_key(F.col("host")))
    n = buckets or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _bounds(urls.select("key"), n)

    starts = spark.createDataFrame([(b,) for b in sorted(set(bounds))], "key string")
    opens = sizes.select(F.col("r_key").alias("key"))
    at_open = _stacks(opens.unionByName(starts).distinct(), own)
    # After the interval of com.example. ends, what holds com. is active again.
    closing = opens.select("key", F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")).alias("after"), F.regexp_extract("key", r"^(.*\.)[^.]*\.$", 1).alias("parent"))
    at_close = closing.join(_stacks(closing.select(F.col("parent").alias("key")).distinct(), own).withColumnRenamed("key", "p_key"), F.col("parent") == F.col("p_key"), "left")
    edges = at_open.select("key", F.lit(1).alias("kind"), "stack", "wide").unionByName(at_close.select(F.col("after").alias("key"), F.lit(0).alias("kind"), "stack", "wide"))
    lowest, highest = _below(bounds, F.col("key"), False), _below(bounds, F.col("key"), True)
    none = lambda c: F.coalesce(c, F.array().cast(edges.schema[c].dataType)).alias(c)
    edges = edges.select("key", "kind", none("stack"), none("wide"), F.explode(F.sequence(lowest, highest)).alias("bucket"))
    spread = lowest + F.floor(F.rand(11) * (highest - lowest + 1)).cast("int")
    rows = urls.select("key", F.lit(2).alias("kind"), spread.alias("bucket"), "page", "host", "path")
    both = rows.unionByName(edges, allowMissingColumns=True)
    sweep = Window.partitionBy("bucket").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).withColumn("asked", F.last("wide", ignorenulls=True).over(sweep)).where("kind = 2")
    best = F.get(F.filter("active", lambda r: F.startswith(F.col("path"), r["r_path"])), F.lit(0))
    judged = swept.select("page", "host", "path", best.alias("best"), "asked")
    for i in range(_nested(many)):
        judged = _with_longest_path(written(judged), rules.join(many, "r_key"), F.get("asked", F.lit(i)), n)
    return judged.select("page.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))
