"""URL filters: longest-prefix rules by a sort-merge range join.

A rule is a host and a path prefix. Its canonical key is the host with labels reversed, a
separator and the path, so all that it fits lie in one interval of keys. A page is looked up
under every suffix of its host. Rule boundaries and page keys are range-partitioned and
sorted together; every boundary carries the stack of nested rules that are active from
there on, and a page takes the stack of the last boundary before it, from an earlier
partition if need be.

Everything is DataFrame code. Pages of one host spread over partitions, since the sort key
ends in a salt. Only one row per partition is gathered to pass stacks on.

Defined results: a null url, or one without ``://``, has an empty host and path; no rule fits
it. A rule without a host, or with a null path, fits nothing. Of equal rules the one whose action
sorts first counts. The longest host and path together win, then the longer host. Repeated pages
give repeated rows; other columns of ``pages`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace

# Rules of the registered query (host, path, action).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

SEPARATOR = "\x01"
#: Keys are sorted as UTF-8 bytes, among which this one doesn't occur: it sorts after every continuation of a key.
LAST = bytes([255])


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, action string")


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    rest = F.when(F.locate("://", "url") > 0, F.expr("substr(url, locate('://', url) + 3)"))
    parts = pages.select("page_id", F.coalesce(rest, F.lit("")).alias("_rest"))
    host = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    # Only A-Z change; upper-case letters of other alphabets stay.
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return parts.select("page_id", lower.alias("host"), F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def _key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(SEPARATOR), path)


def _boundaries(rules: DataFrame) -> DataFrame:
    """(key, depth order, stack): where the stack of active rules changes, and what it is from there.

    A rule's stack is itself and every rule whose key is a proper prefix of its own, found by an
    equi-join on the prefixes. It holds from the rule's key; the stack without the rule holds from
    the end of its interval.
    """
    r = rules.where((F.col("rule_host") != "") & F.col("rule_path").isNotNull())
    r = r.groupBy("rule_host", "rule_path").agg(F.min("action").alias("action"))
    r = r.select(_key(F.col("rule_host"), F.col("rule_path")).alias("key"), F.struct("rule_host", "rule_path", "action").alias("rule"))
    prefixes = r.select(F.col("key").alias("own"), F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring("key", F.lit(1), n))).alias("key"))
    stacks = prefixes.join(r, "key").groupBy("own").agg(F.sort_array(F.collect_list(F.struct(F.length("key").alias("n"), "rule"))).alias("s"))
    starts = stacks.select(F.col("own").cast("binary").alias("key"), F.lit(1).alias("side"), F.length("own").alias("deep"), F.transform("s", lambda x: x["rule"]).alias("stack"))
    # Where nested intervals end together the outermost must come last, so that its outside holds.
    ends = stacks.select(
        F.concat(F.col("own").cast("binary"), F.lit(LAST)).alias("key"),
        F.lit(0).alias("side"),
        (-F.length("own")).alias("deep"),
        F.transform(F.slice("s", 1, F.size("s") - 1), lambda x: x["rule"]).alias("stack"),
    )
    return starts.unionByName(ends)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", *, workspace: Workspace | None = None) -> DataFrame:
    """page_id, host, path, rule (host and path of the longest rule that fits, else null), verdict."""
    ws = Workspace.of(pages.sparkSession, workspace)
    p = with_host_and_path(pages)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    # A host that spans an uncommon number of labels is looked up under every one of them.
    looked = p.select("page_id", "host", "path", F.posexplode(suffixes).alias("nth", "suffix"))
    looked = looked.select(
        _key(F.col("suffix"), F.col("path")).cast("binary").alias("key"),
        F.lit(2).alias("side"),
        F.xxhash64("page_id", "nth").alias("deep"),
        "page_id", "host", "path", "nth", "suffix",
    )
    events = looked.unionByName(_boundaries(rules), allowMissingColumns=True)
    # Written, so that a lost executor can't change which partition a row is in.
    events = ws.keep(events.repartitionByRange("key", "side", "deep").withColumn("part", F.spark_partition_id()))

    order = F.struct("key", "side", "deep")
    last = events.where(F.col("side") < 2).groupBy("part").agg(F.max_by("stack", order).alias("last"))
    parts = events.select("part").distinct().join(last, "part", "left")
    carried = parts.select("part", F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    # One row per partition of the sort: the size of this side is the number of partitions.
    swept = events.join(F.broadcast(carried), "part").withColumn(
        "active",
        F.coalesce(F.last("stack", ignorenulls=True).over(Window.partitionBy("part").orderBy("key", "side", "deep").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "carried"),
    )
    fits = F.filter(F.coalesce("active", F.array().cast(events.schema["stack"].dataType)), lambda r: (r["rule_host"] == F.col("suffix")) & F.startswith(F.col("path"), r["rule_path"]))
    scored = F.transform(fits, lambda r: F.struct((F.length(r["rule_host"]) + F.length(r["rule_path"])).alias("n"), F.length(r["rule_host"]).alias("h"), F.concat(r["rule_host"], r["rule_path"]).alias("rule"), r["action"].alias("action")))
    found = swept.where(F.col("side") == 2).select("page_id", "host", "path", "nth", F.array_max(scored).alias("best"))
    # Equal pages have equal results, so they are counted and written out again.
    best = found.groupBy("page_id", "host", "path").agg(F.max("best").alias("best"), F.sum((F.col("nth") == 0).cast("int")).alias("copies"))
    return best.select(
        "page_id", "host", "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")
