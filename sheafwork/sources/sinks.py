"""Rows as they leave: receipts, result lists, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fenced


def receipts(pages: DataFrame) -> DataFrame:
    """(url, final_url, fetched_at, backend, status, chars, text) of scrubbed
    pages: ``chars`` before fencing; text with findings is fenced."""
    return pages.select(
        "url",
        F.coalesce("final_url", "url").alias("final_url"),
        F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fetched_at"),
        "backend",
        "status",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"),
        fenced(F.col("text"), F.size("findings")).alias("text"),
    )


def result_line(rank: Column, title: Column, url: Column, snippet: Column, source: Column, *, terminal: bool = True) -> Column:
    """A numbered entry.  For a terminal the snippet is on one line of 200 at
    most and the source follows; else the snippet stays as it is, alone."""
    name = F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.lit("(no title)"))
    indented = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("   "), c))
    first = F.concat(rank.cast("string"), F.lit(". "), name)
    if not terminal:
        return F.concat_ws("\n", first, F.concat(F.lit("   "), url), indented(snippet))
    flat = F.trim(F.replace(F.coalesce(snippet, F.lit("")), F.lit("\n"), F.lit(" ")))
    short = F.when(F.length(flat) > 200, F.concat(F.substring(flat, 1, 197), F.lit("..."))).otherwise(flat)
    labelled = F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit("["), source, F.lit("]")))
    return F.concat_ws("\n", first, F.concat(F.lit("   "), url), indented(short), indented(labelled))


def result_lists(fused: DataFrame, by: str = "query", *, terminal: bool = True) -> DataFrame:
    """(query, listing): the entries of a query in order of rank."""
    line = result_line(F.col("rank"), F.col("title"), F.col("url"), F.col("snippet"), F.col("source"), terminal=terminal)
    rows = fused.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("rows"))
    return rows.select(by, F.array_join(F.transform("rows", lambda r: r["line"]), "\n" if terminal else "\n\n").alias("listing"))


def as_json(frame: DataFrame, *keys: str) -> DataFrame:
    """The keys and every row as one JSON text."""
    return frame.select(*keys, F.to_json(F.struct(*frame.columns)).alias("json"))


def write_transcripts(transcripts: DataFrame, path: str) -> None:
    """A line-terminated text for each row (text)."""
    transcripts.select(F.regexp_replace("text", r"\n+\z", "").alias("value")).write.text(path, lineSep="\n")
