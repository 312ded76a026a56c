"""Token ids as directly addressable codes.

An id is split into chunks of 8 bits, low chunk first.  Level k holds the k-th
chunk of every id that has one, a bitmap says which ids go on to level k+1, and
a directory holds the number of set bits before every 512th bit.  To read ids
[a, b): take level 0 at [a, b), then the rank of a and of b in its bitmap
give the place at level 1, and so on; nothing else is decoded.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, slices, with_end

MAGIC = b"DAC1"
RANK_BITS = 512
#: A segment is closed at the first document end at or past so many ids.
SEGMENT_IDS = 1 << 18

_SEGMENTS = "part int, segment int, first_id long, n_ids long, codes binary, doc_ids array<long>, doc_tokens array<long>"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def dac_encode(ids: np.ndarray) -> bytes:
    """The ids (unsigned 32-bit) as one directly addressable block."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        pad = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS, np.uint32)
        pad[: len(more)] = more
        ranks = np.concatenate([[0], np.cumsum(pad.reshape(-1, RANK_BITS).sum(1))]).astype("<u4")
        levels.append(struct.pack("<QI", len(rest), len(ranks)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        if not more.any():
            return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)
        rest = rest[more] >> 8


class DacReader:
    """Random access to a block of :func:`dac_encode`; builds no decoded copy."""

    def __init__(self, block: bytes):
        if block[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        self.levels, at = [], 8
        for _ in range(struct.unpack_from("<I", block, 4)[0]):
            n, m = struct.unpack_from("<QI", block, at)
            chunks = np.frombuffer(block, np.uint8, n, at + 12)
            bits = np.frombuffer(block, np.uint8, -(-n // 8), at + 12 + n)
            ranks = np.frombuffer(block, "<u4", m, at + 12 + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 12 + n + len(bits) + 4 * m

    def __len__(self) -> int:
        return len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, at: int) -> int:
        block = at // RANK_BITS
        part = np.unpackbits(bits[block * RANK_BITS // 8 : -(-at // 8)], count=at - block * RANK_BITS, bitorder="little")
        return int(ranks[block]) + int(part.sum())

    def slice(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop] as unsigned 32-bit."""
        if not 0 <= start <= stop <= len(self):
            raise IndexError((start, stop))
        out = np.zeros(stop - start, np.uint32)
        at = np.arange(stop - start)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            if start == stop:
                break
            out[at] |= chunks[start:stop].astype(np.uint32) << (8 * k)
            more = np.unpackbits(bits[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start].astype(bool)
            low = self._rank(bits, ranks, start)
            start, stop, at = low, low + int(more.sum()), at[more]
        return out

    def take(self, at: np.ndarray) -> np.ndarray:
        """The ids at these places: a rank for each and level, nothing else."""
        if len(at) and not 0 <= at.min() <= at.max() < len(self):
            raise IndexError((at.min(), at.max()))
        out, own, at = np.zeros(len(at), np.uint32), np.arange(len(at)), at.astype(np.int64)
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            out[own] |= chunks[at].astype(np.uint32) << np.uint32(8 * k)
            goes_on = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            own, at = own[goes_on], at[goes_on]
            if len(own) == 0:
                break
            block = at // RANK_BITS
            used, which = np.unique(block, return_inverse=True)
            pad = np.concatenate([bits, np.zeros(RANK_BITS // 8, np.uint8)])
            before = np.cumsum(np.unpackbits(pad[used[:, None] * (RANK_BITS // 8) + np.arange(RANK_BITS // 8)], axis=1, bitorder="little"), 1, dtype=np.int64)
            at = ranks[block].astype(np.int64) + before[which, at % RANK_BITS] - 1  # its own bit is set
        return out

    def get(self, at: int) -> int:
        return int(self.slice(at, at + 1)[0])


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, leading_space: bool = True) -> None:
    """Encode every whole text (null: empty) and write segments in ascending id order.

    Spark deals the documents out in ranges of ids and sorts each range; a task
    streams its range into segments.  A document is never cut by a segment.
    Null ids come first.  Repeated ids go by their texts' hashes, then texts,
    so that one that holds many rows is dealt to many tasks.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        bulk = encoder(tokenizer_path, leading_space)
        held, doc_ids, sizes, n = [], [], [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first]), pa.array([n]), pa.array([dac_encode(np.concatenate(held))], pa.binary()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64()))],
                names=["part", "segment", "first_id", "n_ids", "codes", "doc_ids", "doc_tokens"],
            )

        for batch in batches:
            for piece in slices(batch, "text"):
                ids, bounds = with_end(*bulk.encode(pc.fill_null(piece["text"], "")), end_id)
                own = piece["doc_id"].to_pylist()
                k = 0
                while k < len(own):
                    stop = max(k + 1, int(np.searchsorted(bounds, bounds[k] + SEGMENT_IDS - n, "left")))
                    stop = min(stop, len(own))
                    held.append(ids[bounds[k] : bounds[stop]])
                    doc_ids += own[k:stop]
                    sizes += np.diff(bounds[k : stop + 1]).tolist()
                    n += int(bounds[stop] - bounds[k])
                    k = stop
                    if n >= SEGMENT_IDS:
                        yield closed()
                        segment, first = segment + 1, first + n
                        held, doc_ids, sizes, n = [], [], [], 0
        if doc_ids:
            yield closed()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = own.withColumn("h", F.xxhash64("text"))
    ordered = hashed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered.select("doc_id", "text").mapInArrow(segments, _SEGMENTS).write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with the global offset of each one's first id."""
    files = spark.read.schema(_SEGMENTS).parquet(path)
    bases = common.partition_bases(files.select("part", "n_ids"), "part", "n_ids")
    return files.join(bases, "part").withColumn("start", F.col("base") + F.col("first_id"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row per stored document, read through the codes: doc_id, start (ids of
    all documents before it), n_tokens, ids_crc32."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                reader = DacReader(batch["codes"][row].as_py())
                sizes = np.array(batch["doc_tokens"][row].as_py(), np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                crcs = [zlib.crc32(reader.slice(a, b).astype("<u4").tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_ids"][row].values, pa.array(batch["start"][row].as_py() + bounds[:-1]), pa.array(sizes), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return read_segments(spark, path).select("codes", "doc_ids", "doc_tokens", "start").mapInArrow(documents, _READ)


#: Positions of a segment that are read together.
_TOGETHER = 1 << 16


def read_tokens(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """Random access: a row (position, id) for each distinct position.

    Segments are found by their offsets alone: positions and segments meet in
    stretches of as many ids as a segment has, so the join is by equality and
    a position meets the few segments of its stretch.  Then a segment's
    positions are gathered, some 65,000 at a time, and its codes are opened
    once for them.  Positions outside the store, and null, are dropped.
    """
    bounds = read_segments(spark, path).select("part", "segment", "start", "n_ids").where("n_ids > 0")
    stretch = lambda c: F.floor(c / SEGMENT_IDS)
    cover = F.sequence(stretch(F.col("start")), stretch(F.col("start") + F.col("n_ids") - 1))
    bounds = common.written(bounds.withColumn("stretch", F.explode(cover)), "token-bounds")
    asked = positions.select(F.col("position").cast("long").alias("position")).distinct().withColumn("stretch", stretch(F.col("position")))
    hit = asked.join(bounds, "stretch").where("position >= start and position < start + n_ids")
    groups = hit.groupBy("part", "segment", "start", F.floor((F.col("position") - F.col("start")) / _TOGETHER).alias("k")).agg(F.collect_list("position").alias("positions"))
    codes = spark.read.schema(_SEGMENTS).parquet(path).select("part", "segment", "codes")

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = np.sort(batch["positions"][row].values.to_numpy())
                found = DacReader(batch["codes"][row].as_py()).take(own - batch["start"][row].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(found.astype(np.int64))], names=["position", "id"])

    return groups.join(codes, ["part", "segment"]).select("positions", "start", "codes").mapInArrow(ids, "position long, id long")
