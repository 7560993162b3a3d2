"""URL rules by a sort-merge range join; DataFrame functions only.

A host is written with its labels in reverse order and a dot after each
(``com.example.www.``), so a rule's host and its subdomains are the strings that
begin with the rule's key: an interval, and any two intervals are nested or
apart.  Rules and urls are sorted together by key.  Each rule start carries the
stack of rules that are open there (its own and those around it); a url takes
the last stack before it, drops the rules that its key has left, and keeps the
longest rule whose path fits.

A sweep is cut by the top label and a salt, so that no host meets in one task;
the rules of a top label are put into each of its sweeps.  There are at least ``SALTS``
of them, and so many that a sweep has about ``SWEEP_ROWS`` urls.

Results for odd input: a null url, or one without ``://``, has an empty host and
path, no rule and the default verdict; repeated rows are judged each; equal
rules with both verdicts block; an empty table gives no rows; other columns are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from termloom.llm.common import parts_for, table

SALTS, SWEEP_ROWS = 256, 1 << 20
DEFAULT = "allow"
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url; both empty without ``://``."""
    rest = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)\A.*?://", "")).otherwise("")
    return F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): for each rule host its rules and those of the hosts around it."""
    by_key = rules.select(reversed_key(F.translate("host", UPPER, LOWER)).alias("key"), F.struct((F.length("host") + F.length("path")).alias("size"), (F.col("verdict") == "block").alias("blocks"), F.concat("host", "path").alias("rule"), "path", "verdict").alias("r")).groupBy("key").agg(F.collect_set("r").alias("own"))
    labels = F.split(F.expr("rtrim('.', key)"), r"\.")
    around = by_key.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))).alias("outer"))
    owned = by_key.select(F.col("key").alias("outer"), F.transform("own", lambda r: F.struct(F.col("key").alias("key"), *[r[c].alias(c) for c in ("size", "blocks", "rule", "path", "verdict")])).alias("own"))
    return around.join(owned, "outer").groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``."""
    host, path = host_and_path(F.col(url_col))
    salts = parts_for(pages.count(), SWEEP_ROWS, SALTS)
    top = F.substring_index("key", ".", 1).alias("top")
    points = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("salt")).withColumn("key", reversed_key(F.col("host")))
    stacks = rule_stacks(rules)
    points = points.select(top, "salt", "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    starts = stacks.select(top, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "key", F.lit(0).alias("kind"), F.lit(None).cast(pages.schema[id_col].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack")
    sweep = W.partitionBy("top", "salt").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = points.unionByName(starts).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = F.filter("open", lambda r: F.col("key").startswith(r["key"]) & F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["blocks"].alias("blocks"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return swept.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ", ".join("('" + "', '".join(rule) + "')" for rule in RULES)
    return judge(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {rules} AS rules(verdict, host, path)"))


ORACLE = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), judged AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM cut)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""
