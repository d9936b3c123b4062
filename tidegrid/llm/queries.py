"""The problem queries of this subpackage: percentiles, and those over texts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.spelling import is_finite
from tidegrid.llm.leakage import leaked
from tidegrid.llm.packing import pack, token_count
from tidegrid.llm.percentiles import histogram_percentiles, merge_histograms, radix_histogram, radix_percentiles
from tidegrid.llm.repetition import repetition
from tidegrid.operators.common import current_rows
from tidegrid.session import materialize

#: Folder of the public tokenizers' files; every node has it at the same place.
TOKENIZERS = os.environ.get("TIDEGRID_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that the byte-level rank files were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048
#: Reviews a container holds at most, and half of what attention over a full container of one text costs.
MOST_TEXTS, MOST_ATTENTION = 64, CAPACITY**2 // 2


#: Percentiles asked for, and the groupings they are wanted in.
PROBS = [0.5, 0.9, 0.99]
SCOPES = {"metric": ["metric"], "region": ["metric", "region"]}


def _metric_values(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.read.parquet(f"{sf}/samples.parquet").select("series_ref", "metric", F.col("labels")["region"].alias("region"), "ts", "value", "seq")
    return current_rows(s, ["series_ref", "metric", "region"]).where(is_finite(F.col("value"))).select("metric", "region", "ts", "value")


def _of_a_region(df: DataFrame) -> DataFrame:
    """Without the rows that stand for a metric's values of no region."""
    return df.where((F.col("scope") == "metric") | F.col("region").isNotNull())


def p7_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Median, 90th and 99th percentile of every metric, and of every metric and region, exactly."""
    # The order statistics around each rank; the interpolated value is left to the reader, as its last bit depends on the formula.
    exact = radix_percentiles(_metric_values(spark, sf), ["metric", "region"], "value", PROBS, scopes=SCOPES)
    return _of_a_region(exact).select("metric", "scope", "region", "p", "lower", "upper", "n")


def p7_merged_days(spark: SparkSession, sf: str) -> DataFrame:
    """The same from histograms made day by day and combined, within a relative error of 2**-12."""
    v = _metric_values(spark, sf).withColumn("day", F.expr("ts div 86400000"))
    daily = materialize(radix_histogram(v, ["metric", "region", "day"], "value"), "daily-histograms")
    parts = []
    for scope, by in SCOPES.items():
        merged = histogram_percentiles(merge_histograms([daily], by), by, PROBS)
        parts.append(merged.select("metric", F.lit(scope).alias("scope"), *(["region"] if "region" in by else [F.lit(None).cast("string").alias("region")]), "p", "value", "n"))
    return _of_a_region(parts[0].unionByName(parts[1]))


def p7_days_within(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each percentile combined from days lies within the stated error of the exact one."""
    key = lambda df: df.withColumn("_r", F.coalesce(F.concat(F.lit("="), "region"), F.lit("-")))
    merged, exact = key(p7_merged_days(spark, sf)), key(p7_percentiles(spark, sf)).select("metric", "scope", "_r", "p", "lower", "upper")
    error = lambda c: F.abs(F.col(c)) * F.lit(2.0**-12)
    within = (F.col("value") >= F.col("lower") - error("lower")) & (F.col("value") <= F.col("upper") + error("upper"))
    return merged.join(exact, ["metric", "scope", "_r", "p"], "left").select("metric", "scope", "region", "p", "n", F.coalesce(within, F.lit(False)).alias("within"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every review in containers of 2,048 tokens, 64 texts and a bounded cost of attention."""
    sized = _documents(spark, sf).select("doc_id", token_count(F.col("text"), f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken", PATTERN).alias("n_tokens"))
    return pack(sized, "doc_id", "n_tokens", CAPACITY, MOST_TEXTS, MOST_ATTENTION)


def p8_limits(spark: SparkSession, sf: str) -> DataFrame:
    """One row: the reviews in containers, how many are not whole in consecutive pieces, and containers over each limit."""
    packed = materialize(p8_containers(spark, sf), "containers")
    texts = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.countDistinct("piece").alias("d"), F.max("piece").alias("top"), F.sum((F.col("tokens") < CAPACITY).cast("int")).alias("short"))
    whole = (F.col("k") == F.col("d")) & (F.col("top") == F.col("k") - 1) & (F.col("short") <= 1)
    texts = texts.agg(F.count(F.lit(1)).alias("texts"), F.count(F.when(~whole, 1)).alias("not_whole"))
    held = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.sum(F.col("tokens") * F.col("tokens")).alias("a"))
    over = lambda c: F.count(F.when(c, 1))
    # A piece that alone exceeds a limit stands alone.
    held = held.agg(over(F.col("t") > CAPACITY).alias("over_tokens"), over(F.col("n") > MOST_TEXTS).alias("over_texts"), over((F.col("a") > MOST_ATTENTION) & (F.col("n") > 1)).alias("over_attention"))
    return texts.join(held)  # of one row each


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a passage of a test item, with the item."""
    return leaked(_documents(spark, sf), "doc_id", "text", spark.read.parquet(f"{sf}/eval_items.parquet"), "eval_id", "passage")


def p10_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The repeated share of every document and its longest repeat."""
    return _documents(spark, sf).select("doc_id", repetition(F.col("text")).alias("r")).select("doc_id", "r.*")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of which more than half is repetition."""
    return p10_shares(spark, sf).where(2 * F.col("repeated") > F.col("units")).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p7_percentiles": p7_percentiles, "p7_merged_days": p7_merged_days, "p7_days_within": p7_days_within, "p8_containers": p8_containers, "p8_limits": p8_limits, "p9_found": p9_found, "p10_found": p10_found, "p10_shares": p10_shares}


_RANKED = """v AS (SELECT metric, labels['region'] AS region, value FROM (SELECT *, row_number() OVER (PARTITION BY series_ref, ts ORDER BY seq DESC) AS rn FROM samples) WHERE rn = 1 AND value IS NOT NULL AND isfinite(value)),
s AS (SELECT metric, 'metric' AS scope, CAST(NULL AS VARCHAR) AS region, value FROM v UNION ALL SELECT metric, 'region', region, value FROM v WHERE region IS NOT NULL),
p AS (SELECT unnest([0.5, 0.9, 0.99]::DOUBLE[]) AS p)"""

P7 = f"""WITH {_RANKED}, r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY metric, scope, region) AS n FROM s WINDOW w AS (PARTITION BY metric, scope, region ORDER BY value))
SELECT metric, scope, region, p, max(CASE WHEN i = floor(p * (n - 1)) THEN value END) AS lower, max(CASE WHEN i = ceil(p * (n - 1)) THEN value END) AS upper, n FROM r, p GROUP BY metric, scope, region, p, n"""

P7_WITHIN = f"WITH {_RANKED}, g AS (SELECT metric, scope, region, count(*) AS n FROM s GROUP BY ALL) SELECT metric, scope, region, p, n, TRUE AS within FROM g, p"


P8_LIMITS = "SELECT count(*) AS texts, 0::BIGINT AS not_whole, 0::BIGINT AS over_tokens, 0::BIGINT AS over_texts, 0::BIGINT AS over_attention FROM documents"


def oracle_sql() -> dict[str, str]:
    """Tokenizers, alterations and folded text are beyond SQL; the tests hold them against brute force."""
    return {"p7_percentiles": P7, "p7_days_within": P7_WITHIN, "p8_limits": P8_LIMITS}
