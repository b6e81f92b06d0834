"""Operator 4: URL filters by host-suffix and path-prefix expressions, natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

PREFIX = 8   # hex digits of the digest that are joined on
SALTS = 16   # a common expression's rows are dealt over so many keys


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://`` or when null.

    The host ends at the first ``/``, ``?`` or ``#``, the path at ``?`` or ``#``;
    user names and ports stay part of the host."""
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.when(has, lower_ascii(host)).otherwise(""), F.when(has, path).otherwise("")


def label_count(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Host suffixes at label starts with path prefixes, of the (labels, path length) that
    rules have, an array."""
    fitting = F.filter(F.array(*[F.struct(F.lit(k).alias("labels"), F.lit(n).alias("chars")) for k, n in shapes]),
                       lambda s: (s["labels"] <= label_count(host)) & (s["chars"] <= F.length(path)))
    return F.transform(fitting, lambda s: F.concat(
        F.call_function("substring_index", host, F.lit("."), -s["labels"]), F.lit("\n"),
        F.substring(path, F.lit(1), s["chars"])))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow",
               page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages``.

    ``rules`` has host, path and verdict; the host fits itself and its subdomains, the
    path what starts with it.  The rule of the most characters wins, then that of the
    longer host, then block before allow; without one the rule is null and the verdict
    ``default``.  The expressions of each different (host, path) are joined to the rules
    on the first digits of their SHA-256 and a salt, so that an expression that most of them share is dealt
    over ``SALTS`` keys (Spark sends the rules to all tasks by itself where their
    measured size allows it); full digests are compared after that.  Null urls
    and such without ``://`` have empty parts; repeated rows stay; empty tables work.
    Only suffixes and prefixes of lengths that rules have are built, so a url costs as much
    as it is long, whatever its number of labels; the different (labels, path length) of the rules
    (some hundreds at most) go to the driver.  Other columns of ``pages`` are not looked at."""
    rules = (rules.select(lower_ascii(F.col("host")).alias("r_host"), F.col("path").alias("r_path"),
                          "verdict")
             .groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict"))  # block wins
             .withColumn("r_digest", F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256)))
    shapes = sorted(tuple(r) for r in rules.select(
        label_count(F.col("r_host")), F.length("r_path")).distinct().collect())
    host, path = url_parts(F.col(url))
    p = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    if not shapes:
        return p.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    e = (p.filter(F.col("host") != "").select("host", "path").distinct()
         .select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), shapes))
                 .alias("expr"))
         .withColumn("digest", F.sha2("expr", 256))
         .withColumn("prefix", F.substring("digest", 1, PREFIX))
         .withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")))
    r = (rules.withColumn("r_prefix", F.substring("r_digest", 1, PREFIX))
         .withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"))
    best = (e.join(r, (F.col("prefix") == F.col("r_prefix")) & (F.col("salt") == F.col("r_salt")))
            .filter(F.col("digest") == F.col("r_digest"))
            .groupBy(F.col("host").alias("b_host"), F.col("path").alias("b_path"))
            .agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"),
                                   F.col("r_verdict").alias("verdict")), rank).alias("best")))
    return p.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")),
                  "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                                 F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
