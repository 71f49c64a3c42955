"""URL rules by a blocked Bloom filter and an exact hash join.

A rule lists a canonical URL prefix: a host (with all its subdomains) and the start of a
path. A URL's possible keys are its host's endings cut at dots and its path's beginnings
of the lengths that rules have. Every key's hash names one block of the filter and one bit
in each of the block's eight words; keys whose bits are all set join the rules exactly, so
no false positive is left. Of the rules that fit, the longest wins.

The filter has at most ``MAX_BLOCKS`` blocks (16 MB), whatever the number of rules: only
it is broadcast. More rules make more false positives, which the exact join takes out.

Nulls: a null URL, or one without ``://``, has an empty host and path. Rules with a null
are ignored; of rules with one host and path, ``block`` holds. A URL that no rule fits
isn't listed and is allowed. Repeated rows are kept; an empty table gives an empty result.
Equal hosts and paths are judged once, so that a hot host is no hot task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 18
#: Rules for each block of 512 bits, so that about one key in a thousand passes by chance.
RULES_A_BLOCK = 32
WORDS = 8
#: Fixed by the query's contract: (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: F.Column) -> F.Column:
    found = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _hashed(df: DataFrame, blocks: int) -> DataFrame:
    """The block and the eight one-bit masks of the key (host, path)."""
    bits = F.xxhash64("path", "host")
    block = F.pmod(F.xxhash64("host", "path"), F.lit(blocks)).cast("int")
    powers = F.array(*(F.lit(-(1 << 63) if i == 63 else 1 << i) for i in range(64)))
    masks = {f"m{k}": F.element_at(powers, F.shiftrightunsigned(bits, 6 * k).bitwiseAND(63).cast("int") + 1) for k in range(WORDS)}
    return df.withColumn("block", block).withColumns(masks)


def build_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """One row ``(block, w0..w7)`` for each block in use."""
    words = [F.bit_or(f"m{k}").alias(f"w{k}") for k in range(WORDS)]
    return _hashed(listed.select("host", "path"), blocks).groupBy("block").agg(*words)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row of ``pages``; rules are ``(host, path, verdict)``."""
    listed = (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
        .dropna()
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
    )
    sizes = listed.agg(F.count("*").alias("n"), F.collect_set(F.length("path")).alias("paths"), F.collect_set(F.size(F.split("host", r"\."))).alias("labels")).first()
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * RULES_A_BLOCK < sizes["n"]:
        blocks *= 2
    url = F.col(url_col).cast("string")
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    different = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    lengths = F.array(*(F.lit(x).cast("int") for x in sorted(sizes["paths"])))
    endings = F.array(*(F.lit(x).cast("int") for x in sorted(sizes["labels"])))
    keys = (
        different.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), labels.alias("labels"))
        .withColumn("cut", F.explode(F.filter(endings, lambda n: n <= F.size("labels"))))
        .withColumn("upto", F.explode(F.filter(lengths, lambda n: n <= F.length("of_path"))))
        .select(
            "of_host",
            "of_path",
            F.expr("array_join(slice(labels, -cut, cut), '.')").alias("host"),
            F.expr("substring(of_path, 1, upto)").alias("path"),
        )
    )
    bloom = F.broadcast(build_filter(listed, blocks))
    passed = _hashed(keys, blocks).join(bloom, "block")
    passed = passed.filter(reduce(lambda a, b: a & b, (F.col(f"w{k}").bitwiseAND(F.col(f"m{k}")) == F.col(f"m{k}") for k in range(WORDS))))
    rule = F.concat("host", "path")
    fits = passed.select("of_host", "of_path", "host", "path").join(listed, ["host", "path"])
    won = fits.groupBy("of_host", "of_path").agg(F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), "verdict")).alias("best"))
    judged = won.select(F.col("of_host").alias("host"), F.col("of_path").alias("path"), "best.rule", "best.verdict")
    return urls.join(judged, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
OP5_SQL = f"""
WITH urls AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES {_VALUES}),
fits AS (
  SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, h || p DESC) AS k
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM urls LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (r)
"""
