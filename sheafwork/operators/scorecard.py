"""Scorecards of capture runs, and roll-ups of injection findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.responses import MIN_CHARS
from ..functions.text import INJECTION_PATTERNS, is_suspect, pattern_counts, strip_invisibles


def scored(cases: DataFrame, captures: DataFrame) -> DataFrame:
    """A row per case: name, url, category, ok, backend, status, chars, error, and
    the case's place ``ord`` if it has one.  ``captures`` has (url, backend, status,
    chars, error): null backend where reading failed."""
    joined = cases.join(captures, "url", "left")
    read = F.col("backend").isNotNull()
    thin = read & ~F.coalesce("allow_thin", F.lit(False)) & (F.col("chars") < MIN_CHARS)
    error = F.when(thin, F.concat(F.lit("thin content ("), F.col("chars").cast("string"), F.lit(f" < {MIN_CHARS} chars)"))).when(~read, F.substring(F.coalesce("error", F.lit("not captured")), 1, 200))
    place = ["ord"] if "ord" in cases.columns else []
    return joined.select("name", "url", "category", (read & ~thin).alias("ok"), "backend", "status", F.when(read, F.col("chars")).otherwise(F.lit(0)).cast("long").alias("chars"), error.alias("error"), *place)


def summary(results: DataFrame) -> DataFrame:
    """(kind, name, passed, total, rate, first): a row for all, for each tier that
    read something (what it read), and for each category; one pass.  ``first`` is
    the least ``ord`` of what it counts, null where results have none."""
    tier = F.when(F.col("ok"), F.col("backend"))
    place = F.col("ord") if "ord" in results.columns else F.lit(None).cast("long")
    base = results.select(tier.alias("tier"), "category", "ok", place.alias("place"))
    sets = base.groupingSets([[], ["tier"], ["category"]], "tier", "category").agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"), F.min("place").alias("first"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, F.lit("all")).when(F.col("g") == 1, F.lit("tier")).otherwise(F.lit("category"))
    rows = sets.select(kind.alias("kind"), F.when(F.col("g") == 1, F.col("tier")).when(F.col("g") == 2, F.col("category")).alias("name"), "passed", "total", "first")
    rate = F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(F.lit(0.0))
    return rows.where((F.col("kind") != "tier") | F.col("name").isNotNull()).select("kind", "name", "passed", "total", rate.alias("rate"), "first")


def percent(rate: Column) -> Column:
    """Whole percents, half to even."""
    return F.bround(rate * 100, 0).cast("int").cast("string")


def _said(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _total_line() -> Column:
    """A summary's row as the line of its section."""
    name, passed, total, share = F.col("name"), F.col("passed"), F.col("total"), percent(F.col("rate"))
    return (
        F.when(F.col("kind") == "all", _said("Read **", passed, "/", total, "** pages (**", share, "%**)."))
        .when(F.col("kind") == "tier", _said("- `", name, "`: ", passed))
        .otherwise(_said("- `", name, "`: ", passed, "/", total, " (", share, "%)"))
    )


def _total_place() -> Column:
    """Tiers by what they read, of equals the first seen; categories by name."""
    tier = F.col("kind") == "tier"
    return F.struct(F.when(tier, -F.col("passed")).otherwise(F.lit(0)).alias("a"), F.when(tier, F.col("first")).cast("long").alias("b"), F.coalesce("name", F.lit("")).alias("c"))


def card(totals: DataFrame) -> DataFrame:
    """One row (markdown) from a summary: what was read, by tier and by category.
    A summary has a row per tier and category, whatever the number of pages."""
    place = F.struct(_total_place().alias("place"), _total_line().alias("line"))
    of = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, place))), lambda r: r["line"]), "\n")
    parts = totals.agg(of("all").alias("all"), of("tier").alias("tier"), of("category").alias("category"))
    tiers = F.when(F.col("tier") != "", F.col("tier")).otherwise(F.lit("- (nothing read)"))
    return parts.select(F.concat("all", F.lit("\n\n## Which tier carried it\n\n"), tiers, F.lit("\n\n## By category\n\n"), "category").alias("markdown"))


#: Lines of the whole card around its tables: section, place in it, line.
_FRAME = (
    (0, 0, "# Capture scorecard"), (0, 1, ""), (1, 1, ""), (2, 0, "## Which tier carried it"), (2, 1, ""), (4, 0, ""), (4, 1, "## By category"), (4, 2, ""),
    (6, 0, ""), (6, 1, "## Per page"), (6, 2, ""), (6, 3, "| Page | Category | Read | Tier | Chars |"), (6, 4, "|------|----------|:----:|------|------:|"),
)
_SECTION = {"all": 1, "tier": 3, "category": 5}


def lines(results: DataFrame) -> DataFrame:
    """(section, place, line): the whole card, a row for each line, in order of
    section and place.  The table of pages is as long as the results, in order
    of ``ord``, so it is never one text; see :func:`write_card`."""
    spark = results.sparkSession
    totals = summary(results)
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(_total_place()))
    section = F.coalesce(*(F.when(F.col("kind") == k, F.lit(n)) for k, n in _SECTION.items()))
    # A window over tiers and categories, never over pages.
    own = totals.select(section.alias("section"), F.when(F.col("kind") == "all", 0).otherwise(rank).cast("long").alias("place"), _total_line().alias("line"))
    nothing = totals.groupBy().agg(F.count_if(F.col("kind") == "tier").alias("n")).where("n = 0").selectExpr("3 AS section", "0L AS place", "'- (nothing read)' AS line")
    frame = spark.createDataFrame(_FRAME, "section int, place long, line string")
    pages = results.select(F.lit(7).alias("section"), F.col("ord").cast("long").alias("place"), page_line().alias("line"))
    return frame.unionByName(own).unionByName(nothing).unionByName(pages)


def write_card(results: DataFrame, path: str) -> None:
    """The whole card as text files, whose lines are in order file by file."""
    lines(results).orderBy("section", "place").select("line").write.text(path)


def page_line() -> Column:
    """A table row for a page; a dash where no tier read it."""
    tier = F.coalesce(F.concat(F.lit("`"), F.col("backend"), F.lit("`")), F.lit("—"))
    return _said("| ", F.col("name"), " | ", F.col("category"), " | ", F.when(F.col("ok"), F.lit("yes")).otherwise(F.lit("no")), " | ", tier, " | ", F.col("chars"), " |")


def page_lines(results: DataFrame) -> DataFrame:
    """(name, line) of each page."""
    return results.select("name", page_line().alias("line"))


def injection_rollup(docs: DataFrame, by: str = "source", text: str = "text", patterns: tuple[str, ...] = INJECTION_PATTERNS) -> DataFrame:
    """(by, pattern, documents, findings) with totals by rollup: null is all.
    ``pattern`` is the pattern's place in the list, from 0."""

    def counts(clean: Column) -> Column:
        return F.when(is_suspect(clean, patterns), pattern_counts(clean, patterns)).otherwise(F.array().cast("array<int>"))

    counted = docs.select(by, F.posexplode(let(strip_invisibles(F.col(text)), counts)).alias("pattern", "n"))
    return counted.where("n > 0").rollup(by, "pattern").agg(F.count("*").alias("documents"), F.sum("n").cast("long").alias("findings"))
