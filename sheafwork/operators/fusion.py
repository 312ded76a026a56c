"""Rank fusion of several providers' result lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import strip
from ..functions.text import findings, strip_invisibles
from ..functions.urls import canonical

#: Fixed value: damping of the first ranks.
RRF_K = 60
#: A rank is below this, so that (provider, rank) is one order.
_STEP = 1 << 32


def requested(names: Column, defaults: tuple[str, ...] = ("ddg",)) -> Column:
    """array<string> of a comma list: trimmed, lower case, distinct, in order."""
    own = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(names, F.lit("")), ","), lambda n: F.lower(strip(n))), lambda n: n != ""))
    return F.when(F.size(own) > 0, own).otherwise(F.array(*(F.lit(d) for d in defaults)))


def outcomes(asked: DataFrame, hits: DataFrame, errors: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """(query, provider, provider_ord, reason) of each requested provider;
    reason is null where it gave hits.  ``asked`` has (query, provider,
    provider_ord), ``errors`` (query, provider, error)."""
    counted = hits.groupBy("query", "provider").agg(F.count("*").alias("n"))
    joined = asked.join(counted, ["query", "provider"], "left").join(errors.select("query", "provider", "error"), ["query", "provider"], "left")
    reason = F.when(~F.col("provider").isin(*known), F.lit("unknown-provider")).when(F.col("error").isNotNull(), F.col("error")).when(F.coalesce("n", F.lit(0)) == 0, F.lit("no-results"))
    return joined.select("query", "provider", "provider_ord", reason.alias("reason"))


def failures(outcome: DataFrame) -> DataFrame:
    """(query, message) of queries without any hit."""
    rows = outcome.groupBy("query").agg(F.count_if(F.col("reason").isNull()).alias("fine"), F.array_sort(F.collect_list(F.struct("provider_ord", "provider", "reason"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: F.concat(r["provider"], F.lit(": "), r["reason"])), "; ")
    return rows.where("fine = 0").select("query", F.concat(F.lit("all search providers failed for '"), F.col("query").cast("string"), F.lit("' -> "), text).alias("message"))


def fused(hits: DataFrame, max_results: int = 10, *, by: str = "query") -> DataFrame:
    """Reciprocal rank fusion: (query, rank, key, score, title, url, snippet, source).

    ``hits`` has (query, provider_ord, rank from 0, title, url, snippet,
    source).  Hits meet by canonical URL; each occurrence adds 1/(60+rank+1),
    in order; the longest title and snippet stay, of equals the first, and the
    first URL.  Scores that tie go by key.  Hits are grouped by (query, key), so
    that a query with very many is dealt out; then each query's best meet.
    """
    order = F.col("provider_ord").cast("long") * _STEP + F.col("rank")
    own = hits.select(by, canonical(F.col("url")).alias("key"), order.alias("o"), (1 / (RRF_K + F.col("rank") + 1)).alias("part"), F.coalesce("title", F.lit("")).alias("title"), "url", F.coalesce("snippet", F.lit("")).alias("snippet"), F.coalesce("source", F.lit("")).alias("source"))
    longest = lambda c: F.max_by(c, F.struct(F.length(c), -F.col("o")))
    grouped = own.groupBy(by, "key").agg(
        F.array_sort(F.collect_list(F.struct("o", "part", "source"))).alias("rows"),
        longest("title").alias("title"),
        longest("snippet").alias("snippet"),
        F.min_by("url", "o").alias("url"),
    )
    score = F.aggregate("rows", F.lit(0.0), lambda s, r: s + r["part"])
    source = F.array_join(F.array_distinct(F.filter(F.transform("rows", lambda r: r["source"]), lambda s: s != "")), ", ")
    scored = grouped.select(by, "key", score.alias("score"), "title", "url", "snippet", source.alias("source"))
    best = Window.partitionBy(by).orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max_results)


def clamp(max_results: int | None) -> int:
    """1 to 25; 5 if not given."""
    return max(1, min(max_results or 5, 25))


def sanitised(results: DataFrame) -> DataFrame:
    """Titles and snippets without invisible characters, and the findings of
    both as ``warnings``; nothing visible changes."""
    clean = results.withColumns({c: strip_invisibles(F.col(c)) for c in ("title", "snippet")})
    return clean.withColumn("warnings", F.concat(findings(F.col("title")), findings(F.col("snippet"))))


def distinct_urls(urls: DataFrame, url: str = "url", order: str = "ord", *, by: tuple[str, ...] = ()) -> DataFrame:
    """(..., key, url): of URLs with one canonical key the first spelling."""
    return urls.groupBy(*by, canonical(F.col(url)).alias("key")).agg(F.min_by(url, order).alias(url))
