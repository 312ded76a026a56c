"""Transcripts from caption files and from chunks of speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import strip

MIN_CAPTION_CHARS = 20
MAX_CHUNK_BYTES = 24 * 1024 * 1024
CHUNK_SECONDS = 600
#: Starts of lines that are no speech.
SKIPPED = ("WEBVTT", "NOTE", "Kind:", "Language:")


def prose(vtt: Column) -> Column:
    """The spoken lines of a caption file: no header, notes, cues, numbers or
    tags, and no line that equals the last kept one."""
    lines = F.transform(F.split(F.coalesce(vtt, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda s: strip(F.regexp_replace(s, "<[^>]+>", "")))

    def spoken(s: Column) -> Column:
        keep = (s != "") & ~F.contains(s, F.lit("-->")) & ~s.rlike(r"\A\p{Nd}+\z")
        for start in SKIPPED:
            keep = keep & ~s.startswith(start)
        return keep

    kept = F.filter(lines, spoken)
    return F.array_join(F.transform(F.array(kept), lambda k: F.filter(k, lambda s, i: (i == 0) | (F.get(k, i - 1) != s)))[0], "\n")


def usable(text: Column) -> Column:
    """Enough characters, spaces aside."""
    return F.coalesce(F.length(F.replace(text, F.lit(" "), F.lit(""))) >= MIN_CAPTION_CHARS, F.lit(False))


def chosen_tracks(tracks: DataFrame) -> DataFrame:
    """(video_id, track, vtt): by name the first written by hand, else the first."""
    name = F.lower("track")
    auto = F.contains(name, F.lit("auto")) | F.contains(name, F.lit(".a."))
    best = tracks.groupBy("video_id").agg(F.min_by(F.struct("track", "vtt"), F.struct(auto.alias("auto"), F.col("track"))).alias("t"))
    return best.select("video_id", "t.*")


def chunk_texts(attempts: DataFrame) -> DataFrame:
    """(video_id, chunk, text, error): of a chunk's providers in order the first
    that worked, else the last error.  ``text`` is null where none did."""
    order = F.col("provider_ord")
    fine = F.col("ok")
    return attempts.groupBy("video_id", "chunk").agg(
        F.min_by("text", F.when(fine, order)).alias("text"),
        F.when(F.count_if(fine) == 0, F.max_by("error", order)).alias("error"),
    )


def stitched(chunks: DataFrame) -> DataFrame:
    """(video_id, text): stripped texts in order of chunk, empty ones left out."""
    rows = chunks.withColumn("text", strip(F.coalesce("text", F.lit(""))))
    lists = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("chunk", "text")))).alias("rows"))
    return lists.select("video_id", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"))


def transcripts(captions: DataFrame, speech: DataFrame) -> DataFrame:
    """(video_id, source, text): captions that are usable, else the speech."""
    own = captions.select("video_id", F.col("text").alias("caption"))
    both = own.join(speech.select("video_id", F.col("text").alias("speech")), "video_id", "full")
    good = usable(F.col("caption"))
    return both.select("video_id", F.when(good, F.lit("captions")).otherwise(F.lit("speech")).alias("source"), F.when(good, F.col("caption")).otherwise(F.col("speech")).alias("text"))


def chunk_plan(audio: DataFrame) -> DataFrame:
    """(video_id, chunk, start, seconds) of rows (video_id, bytes, seconds): one
    chunk for a small file, else pieces of ten minutes."""
    small = F.col("bytes") <= MAX_CHUNK_BYTES
    step = F.lit(CHUNK_SECONDS)
    starts = F.when(small | (F.col("seconds") <= 0), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("seconds").cast("int") - 1, step))
    rows = audio.select("video_id", "seconds", small.alias("small"), F.posexplode(starts).alias("chunk", "start"))
    size = F.when(F.col("small"), F.col("seconds")).otherwise(F.least(step, F.col("seconds") - F.col("start")))
    return rows.select("video_id", "chunk", "start", size.cast("int").alias("chunk_seconds"))
