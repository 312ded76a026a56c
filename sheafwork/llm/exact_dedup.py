"""Exact deduplication with a heavy-hitter split, in built-in functions only.

1. Every row gets the SHA-256 of its text, in a narrow written table; texts are
   read once and not moved.
2. Misra-Gries: Spark's frequent-items sketch (the weighted form of that
   algorithm) finds digests that may hold a HEAVY_SHARE of the rows.  Sketches
   are merged on SKETCH_GROUPS ways first, so no task merges those of all tasks.
3. Candidates are verified by exact counts with map-side combining.  The
   winners, at most 1 / HEAVY_SHARE rows whatever the data, are broadcast, and
   their copies are settled where they lie.
4. The other digests are shuffled as usual: by then no group holds more than
   a HEAVY_SHARE of the rows.

A candidate that the sketch misses costs a larger group in step 4 and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Share of all rows from which a digest is heavy.
HEAVY_SHARE = 0.001
#: Counters of the sketch: it errs by 3.5 / 16384 of the rows at most, so that
#: digests of a HEAVY_SHARE are found, with 1250 others at most before them.
COUNTERS, CANDIDATES = 8192, 2048
SKETCH_GROUPS = 64


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, row) of every row, written: ``row`` tells rows apart that
    have the same id and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    return common.written(own.withColumn("row", F.monotonically_increasing_id()), "dedup-digests")


def _winner() -> Column:
    """What stays of a group: the largest id, null least; of equal ids the first row."""
    return F.max(F.struct("doc_id", (-F.col("row")).alias("back")))


def candidates(table: DataFrame) -> DataFrame:
    """(code): xxhash64 of digests that may be heavy, CANDIDATES rows at most."""
    coded = table.select(F.xxhash64("digest").alias("code"), F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("way"))
    some = coded.groupBy("way").agg(F.expr(f"approx_top_k_accumulate(code, {COUNTERS})").alias("sketch"))
    # Grouped by what is the same in all rows: without a group the sketch of an empty partition cannot be merged.
    whole = some.groupBy(F.col("way") < 0).agg(F.expr(f"approx_top_k_combine(sketch, {COUNTERS})").alias("sketch"))
    return whole.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {CANDIDATES})")).alias("found")).select(F.col("found.item").alias("code"))


def heavy(table: DataFrame) -> DataFrame:
    """(digest, stays, group_size): verified groups of a HEAVY_SHARE of the rows,
    two rows at least.  Written; 1 / HEAVY_SHARE rows at most."""
    total = table.count()
    if total == 0:  # the sketch of no rows has no estimate
        return table.groupBy("digest").agg(_winner().alias("stays"), F.count("*").alias("group_size"))
    least = max(2.0, HEAVY_SHARE * total)
    listed = table.join(F.broadcast(candidates(table)), F.xxhash64("digest") == F.col("code"), "left_semi")
    counted = listed.groupBy("digest").agg(_winner().alias("stays"), F.count("*").alias("group_size"))
    return common.written(counted.where(F.col("group_size") >= least), "dedup-heavy")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with the same text, byte for byte, the one with the largest id stays.
    A null text counts as empty.  A null id is less than any other.  Of rows
    that share text and id one stays.  An empty table gives no rows; other
    columns are not looked at.
    """
    table = digests(docs, id_col, text_col)
    split = table.join(F.broadcast(heavy(table)), "digest", "left")
    group = Window.partitionBy("digest")
    light = split.where("group_size is null").select("doc_id", "digest", "row", _winner().over(group).alias("stays"), F.count("*").over(group).alias("group_size"))
    settled = split.where("group_size is not null").select(*light.columns).unionByName(light)
    kept = F.col("row") == -F.col("stays.back")
    return settled.select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, whole.

    Only rows that share text *and* id with another are compared by their other
    columns: the one with the least hash stays.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("long").alias("own"), F.sha2(text.cast("binary"), 256).alias("sha"))
    found = exact_duplicates(docs, id_col, text_col)
    stays = common.written(found.groupBy("doc_id", "keep_id", "text_sha256").agg(F.count("*").alias("ties")).where("doc_id <=> keep_id").select(F.col("doc_id").alias("own"), F.col("text_sha256").alias("sha"), "ties"), "dedup-stays")
    same = [F.col("l.sha") == F.col("r.sha"), F.col("l.own").eqNullSafe(F.col("r.own"))]
    single = marked.alias("l").join(stays.where("ties = 1").alias("r"), same, "left_semi").select("doc.*")
    tied = marked.alias("l").join(stays.where("ties > 1").alias("r"), same, "left_semi")
    first = tied.groupBy("sha", "own").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    return single.unionByName(first.select("doc.*"))
