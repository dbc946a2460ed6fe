"""URL filters: host-suffix and path-prefix expressions, equi-joined to rules on short digest prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, ascii_lower, table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rules as a table. Hosts are compared in ASCII lower case, paths as they are."""
    if not rules:
        return spark.sql("SELECT '' host, '' path, '' verdict WHERE false")
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS r(host, path, verdict)")


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    return F.coalesce(ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge distinct (host, path) rows by the longest rule that fits; keeps every other column of urls.

    A rule fits its host and all its subdomains if the path starts with the rule's path. Each address
    is expanded into its last labels (no more than the longest rule has) times its directory prefixes
    (no deeper than the deepest rule), so the number of expressions is bounded by the rules and not by
    the address. Expressions meet rules on 32 bits of a SHA-256 digest; the whole digest and the rest
    of the rule's path then confirm. The longest rule (host and path together) wins; of equally long
    ones a block wins. Addresses without host, or that no rule fits, get a null rule and the default.

    Broadcasting is left to Spark, which does it only while the rules are below its size threshold.
    """
    directory = F.regexp_extract("path", r"^(?s)(.*/)?", 0)
    keyed = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), "verdict", directory.alias("r_dir")).distinct()
    keyed = keyed.withColumn("digest", F.sha2(F.concat("r_host", "r_dir"), 256)).withColumn("short", F.substring("digest", 1, 8))
    most = keyed.agg(F.max(F.size(F.split("r_host", r"\."))), F.max(F.length("r_dir") - F.length(F.translate("r_dir", "/", "")))).first()
    labels, depth = int(most[0] or 0), int(most[1] or 0)

    places = urls.where("host <> ''").select("host", "path").distinct()
    cut = places.withColumn("_l", F.split("host", r"\.")).withColumn("_slashes", F.length("path") - F.length(F.translate("path", "/", "")))
    hosts = F.expr(f"transform(sequence(1, least(size(_l), {max(labels, 1)})), i -> array_join(slice(_l, size(_l) - i + 1, i), '.'))")
    paths = F.expr(f"transform(sequence(0, least(_slashes, {depth})), j -> if(j = 0, '', concat(substring_index(path, '/', j), '/')))")
    expressions = cut.select("host", "path", F.explode(hosts).alias("_h"), paths.alias("_p")).select("host", "path", "_h", F.explode("_p").alias("_d"))
    expressions = expressions.withColumn("digest", F.sha2(F.concat("_h", "_d"), 256)).withColumn("short", F.substring("digest", 1, 8))
    r = keyed.withColumnsRenamed({"digest": "r_digest", "short": "r_short"})
    fits = expressions.join(r, F.col("short") == F.col("r_short")).where((F.col("digest") == F.col("r_digest")) & F.startswith("path", "r_path"))
    rule = F.concat("r_host", "r_path")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), F.col("verdict"), rule.alias("rule"))).alias("_best"))
    # addresses without host fit no rule: they don't meet in a join on one empty key
    told = F.coalesce(F.col("host") != "", F.lit(False))
    judged = urls.where(told).join(best, ["host", "path"], "left").unionByName(urls.where(~told).withColumn("_best", F.lit(None).cast(best.schema["_best"].dataType)))
    return judged.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", F.lit(default))}).drop("_best")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages; where no rule fits, null and allow.

    A null url, or one without "://", has an empty host and path and fits no rule. Very long urls are
    expanded no further than the rules reach. Repeated rows and null page_ids are judged like any. An
    empty table gives no rows. Other columns aren't read.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return judge(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS after FROM pages),
u AS (SELECT page_id, translate(regexp_extract(coalesce(after, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(coalesce(after, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(r_host, r_path, r_verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
f AS (SELECT page_id, host, path, r_host || r_path AS rule, r_verdict,
             row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r_host || r_path) DESC NULLS LAST) AS n
      FROM u LEFT JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM f WHERE n = 1
"""
