"""Concatenate-and-cut packing into sequences of a fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, slices, with_end

#: Bytes of text that are encoded at a time.
SLICE_BYTES = 2_000_000

_TOKENS = "part int, ordinal long, doc_id long, start_in_part long, n_tokens long, ids binary"


def tokenized(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, leading_space: bool = False) -> DataFrame:
    """First pass: a written table with a row per document in scan order.

    ``ids`` are little-endian unsigned 32-bit ids, ``end_id`` last;
    ``start_in_part`` counts the ids before it in its partition.  The partition
    number is stored beside the rows, so a task that runs again, or another
    cluster that reads the table, sees the same order.  A null text counts as
    empty; a null id stays null.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, ordinal = TaskContext.get().partitionId(), 0, 0
        bulk = encoder(tokenizer_path, leading_space)
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                n = piece.num_rows
                ids, bounds = with_end(*bulk.encode(pc.fill_null(piece["text"], "")), end_id)
                sizes = np.diff(bounds)
                data = pa.py_buffer(ids.astype("<u4").tobytes())
                blob = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((4 * bounds).astype(np.int64).tobytes()), data]).cast(pa.binary())
                starts = start + bounds[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(ordinal + np.arange(n)), piece["doc_id"], pa.array(starts), pa.array(sizes), blob],
                    names=["part", "ordinal", "doc_id", "start_in_part", "n_tokens", "ids"],
                )
                start, ordinal = start + int(bounds[-1]), ordinal + n

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.written(own.mapInArrow(tokens, _TOKENS), "packing-tokens")


def concatenate_and_cut(tokens: DataFrame, length: int = 2048, *, with_ids: bool = False) -> DataFrame:
    """Second pass over a table of :func:`tokenized`: boundary records.

    Every partition's total gives the global offset of its first id; an id's
    global offset divided by ``length`` is its sequence.  A row per piece
    (a document's part of one sequence): doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, and ``ids`` if asked for.  Only the last
    sequence is short of ``length``.  No row of ids is shuffled.
    """
    bases = common.partition_bases(tokens.select("part", "n_tokens"), "part", "n_tokens")
    placed = tokens.join(bases, "part").withColumn("at", F.col("base") + F.col("start_in_part"))
    size = F.lit(length).cast("long")

    def piece(s):
        low = F.greatest(s * size, F.col("at"))
        high = F.least((s + 1) * size, F.col("at") + F.col("n_tokens"))
        own = F.substring(F.col("ids"), ((low - F.col("at")) * 4 + 1).cast("int"), ((high - low) * 4).cast("int"))
        columns = [(low - F.col("at")).alias("start"), (high - low).alias("length"), F.crc32(own).alias("ids_crc32"), s.alias("sequence_id"), (low - s * size).alias("offset")]
        return F.struct(*columns, *([own.alias("ids")] if with_ids else []))

    first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n_tokens") - 1) / size)
    pieces = placed.select("doc_id", F.col("n_tokens").alias("doc_tokens"), F.transform(F.sequence(first, last), piece).alias("p"))
    out = pieces.select("doc_id", "doc_tokens", F.inline("p"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, **options) -> DataFrame:
    """Both passes.  An empty table gives no rows."""
    return concatenate_and_cut(tokenized(docs, tokenizer_path, **options), length)
