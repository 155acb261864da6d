"""URL allow/block rules as a sort-merge range join over reversed-host keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, shuffle_width


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, ascii_lower(F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*([^?#]*)", 1)).otherwise("")


def reversed_host(host: Column) -> Column:
    """``www.example.com`` -> ``com.example.www.``: a host and its subdomains share a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judges every url by the longest rule that fits it.

    A rule fits its host and all subdomains if the url's path starts with the rule's path.  For one
    rule path the fitting urls are an interval of reversed-host keys, and intervals nest.  Urls and
    rule starts are sorted together by key; the sweep keeps a stack with one slot per depth of
    nesting, each holding the last rule start seen at that depth.  A slot is active while its key is
    a prefix of the url's key; the deepest active slot is the longest rule for that path.

    Urls are dealt to salted sweeps by a hash of the row, and rule starts are repeated in each
    sweep, so a hot host is spread; rules are never broadcast or collected.  Only the distinct
    lengths of rule paths and the distinct depths of rule hosts (small integers) reach the driver.

    Result: ``id, host, path, rule, verdict``, one row per input row.  Null urls and urls without
    ``://`` have empty host and path and get ``default``; empty tables give an empty result; repeated
    rows are kept; rules with a null host or path are ignored; of equal rules ``block`` wins; of
    rules of equal length the one with the longer host, then the greater text, wins.  Other columns
    of the inputs are not read.
    """
    spark = pages.sparkSession
    rules = (
        rules.select("rule_host", "rule_path", "rule_verdict")
        .where("rule_host is not null and rule_path is not null")
        .groupBy(ascii_lower(F.col("rule_host")).alias("rule_host"), "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))
        .withColumn("rule_key", reversed_host(F.col("rule_host")))
        .withColumn("depth", F.size(F.split("rule_host", r"\.", -1)))
    )
    shape = rules.agg(F.collect_set(F.length("rule_path")).alias("lengths"), F.collect_set("depth").alias("depths")).first()
    lengths, depths = sorted(shape["lengths"]), sorted(shape["depths"], reverse=True)

    rows = (
        pages.select(F.col(id_col).alias("row_id"), F.col(url_col).alias("url"))
        .groupBy("row_id", "url")
        .agg(F.count("*").alias("copies"))
        .withColumn("host", host_of(F.col("url")))
        .withColumn("path", path_of(F.col("url")))
    )
    if not lengths:
        best = rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    else:
        sweeps = 4 * shuffle_width(spark)
        fits = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
        prefixes = F.transform(fits, lambda n: F.substring(F.col("path"), F.lit(1), n))
        urls = rows.select(
            F.pmod(F.xxhash64("row_id", "url"), F.lit(sweeps)).cast("int").alias("sweep"),
            F.struct("row_id", "url", "host", "path", "copies").alias("row"),
            reversed_host(F.col("host")).alias("key"),
            F.explode(F.concat(F.array(F.lit(None).cast("string")), prefixes)).alias("prefix"),
            F.lit(1).alias("kind"),
            F.lit(None).cast("int").alias("depth"),
            F.lit(None).cast("string").alias("rule_host"),
            F.lit(None).cast("string").alias("rule_verdict"),
        )
        starts = rules.select(
            F.explode(F.sequence(F.lit(0), F.lit(sweeps - 1))).alias("sweep"),
            F.lit(None).cast(urls.schema["row"].dataType).alias("row"),
            F.col("rule_key").alias("key"),
            F.col("rule_path").alias("prefix"),
            F.lit(0).alias("kind"),
            "depth",
            "rule_host",
            "rule_verdict",
        )
        sweep = Window.partitionBy("sweep").orderBy("prefix", "key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        start = F.struct("prefix", "key", "rule_host", "rule_verdict")
        slots = {f"slot{d}": F.last(F.when((F.col("kind") == 0) & (F.col("depth") == d), start), ignorenulls=True).over(sweep) for d in depths}
        active = reduce(lambda a, b: F.coalesce(a, b), [F.when((F.col("prefix") == F.col(f"slot{d}.prefix")) & F.startswith("key", F.col(f"slot{d}.key")), F.col(f"slot{d}")) for d in depths])
        swept = urls.unionByName(starts).select("sweep", "row", "key", "prefix", "kind", *(c.alias(k) for k, c in slots.items())).where("kind = 1").select("sweep", "row", "prefix", active.alias("hit"))
        text = F.concat("hit.rule_host", "prefix")
        best = (
            swept.groupBy("sweep", "row")
            .agg(F.max(F.when(F.col("hit").isNotNull(), F.struct(F.length(text).alias("n"), F.length("hit.rule_host").alias("h"), text.alias("rule"), F.col("hit.rule_verdict").alias("v")))).alias("best"))
            .select("row.*", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
        )
    return best.withColumn("_", F.explode(F.expr("array_repeat(0, cast(copies as int))"))).select(F.col("row_id").alias(id_col), "host", "path", "rule", "verdict")
