"""Alignment of two tokenizers over the same bytes.

Per block of texts, pandas' ``merge_asof``, keyed by document, finds for each
token start the other side's covering token; both directions together are all
overlapping pairs.  Byte ends that both sides share cut the tokens into groups.

Counts over the corpus: a block of some BLOCK bytes is reduced to its distinct id
pairs before anything is shuffled, so a pair that stands in every document costs
a row for each block.  Blocks get the counts of their pairs back, and a
document looks its own up by place in the block's sorted pairs.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import _BYTES, _PRINTABLE, BulkEncoder

#: Bytes of text in a block, and the size from which one text is cut in parts.
BLOCK = 2 << 20
PART = 1 << 20
#: Distinct pieces that each encoder of a worker remembers.
PIECES = 250_000
#: Bits of a pair of ids in a (document, pair) key.
PAIR_BITS = 34


class Table:
    """Byte strings by number, gathered in bulk."""

    def __init__(self, entries: Sequence[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(entries), np.uint8)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the strings end to end, where each ends)."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.blob[np.repeat(self.start[numbers] - (ends - size), size) + np.arange(int(size.sum()))], ends


class ByteLevel(BulkEncoder):
    """A byte-level vocabulary whose special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path, True)
        self.tokenizer.encode_special_tokens = True
        self.whole = r"[\s\x1c-\x1f\x{85}\p{Z}] |\x01"
        back = {chr(c): b for b, c in _BYTES.items()} | {chr(b): b for b in _PRINTABLE}
        names = sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])
        found = dict((k, bytes(back.get(c, 0) for c in n)) for n, k in names)
        self.table = Table([found.get(k, b"") for k in range(max(found) + 1)])

    def _places(self, pieces: list[str]) -> np.ndarray:
        if len(self.place) > PIECES:
            self._clear()
        return super()._places(pieces)


class PieceLevel:
    """A piece vocabulary that puts a space before a text.

    No piece holds a space after another character, so a text without empty
    words is encoded word by word; a distinct word once, while it is remembered.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.vocab_size())]
        by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.whole = "^ | $|  |▁" if by_word else "(?s)^."
        self.table = Table([bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)])
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.pool, self.ends = array("I"), array("q", [0])

    def _add(self, words: list[str]) -> None:
        for word, ids in zip(words, self.model.encode(words, num_threads=1), strict=True):
            self.pool.extend(ids)
            self.ends.append(len(self.pool))
            self.place[word] = len(self.place)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, ids per text).  Texts must not be null."""
        odd = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        words = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.place) > PIECES:
            self._clear()
        self._add(list(filterfalse(self.place.__contains__, distinct)))
        places = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        pool, ends = np.array(self.pool, np.uint32), np.array(self.ends, np.int64)
        counts = ends[places + 1] - ends[places]
        upto = np.cumsum(counts)
        ids = pool[np.repeat(ends[places] - (upto - counts), counts) + np.arange(int(counts.sum()))]
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))])
        own = np.diff(np.concatenate([[0], upto])[bounds])
        if odd.any():
            at = np.concatenate([[0], np.cumsum(own)])
            parts = [ids[at[k] : at[k + 1]] for k in range(len(texts))]
            bad = np.flatnonzero(odd)
            for k, whole in zip(bad, self.model.encode(texts.take(pa.array(bad)).to_pylist(), num_threads=1), strict=True):
                parts[k] = np.array(whole, np.uint32)
            ids, own = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, own


_LOADED: dict[tuple[str, str], tuple[ByteLevel, PieceLevel, Table]] = {}


def _loaded(a_path: str, b_path: str) -> tuple[ByteLevel, PieceLevel, Table]:
    """The worker's encoders and the decimal names of their ids."""
    if (a_path, b_path) not in _LOADED:
        a, b = ByteLevel(a_path), PieceLevel(b_path)
        names = Table([b"%d," % k for k in range(max(len(a.table.size), len(b.table.size)))])
        _LOADED[a_path, b_path] = a, b, names
    return _LOADED[a_path, b_path]


def _data(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes end to end, bytes of each text)."""
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]], np.diff(bounds)


def _same(table: Table, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Texts whose tokens' bytes are the text's."""
    owner = np.repeat(np.arange(len(counts)), counts)
    ok = np.bincount(owner, table.size[ids], len(counts)).astype(np.int64) == sizes
    joined, _ = table.gather(ids[ok[owner]])
    wrong = joined != data[np.repeat(ok, sizes)]
    if wrong.any():
        ok[np.repeat(np.flatnonzero(ok), sizes[ok])[wrong]] = False
    return ok


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in a, places in b) of tokens that overlap.  Both sides cover
    the same bytes without gaps and are sorted by start."""
    a = pd.DataFrame({"doc": doc_a, "start": start_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"doc": doc_b, "start": start_b, "b": np.arange(len(start_b))})
    under = pd.merge_asof(a, b, on="start", by="doc")["b"].to_numpy(np.int64)
    over = pd.merge_asof(b, a, on="start", by="doc")["a"].to_numpy(np.int64)
    later = start_a[over] != start_b  # equal starts are in both directions
    return np.concatenate([a["a"].to_numpy(), over[later]]), np.concatenate([under, b["b"].to_numpy()[later]])


class Aligned:
    """What a block's texts come to; ``owner`` numbers the document of each."""

    def __init__(self, texts: pa.Array, owner: np.ndarray, documents: int, a_side: ByteLevel, b_side: PieceLevel, names: Table, bad: np.ndarray):
        spaced = pc.binary_join_element_wise(" ", texts, "")
        data, sizes = _data(spaced)
        ids_a, count_a = a_side.encode(spaced)
        ids_b, count_b = b_side.encode(texts)
        ok = _same(a_side.table, ids_a, count_a, data, sizes) & _same(b_side.table, ids_b, count_b, data, sizes)
        bad[owner[~ok]] = True
        ids_a, ids_b = ids_a[np.repeat(ok, count_a)], ids_b[np.repeat(ok, count_b)]
        owner, count_a, count_b = owner[ok], count_a[ok], count_b[ok]
        text = np.arange(len(owner))
        text_a, text_b = np.repeat(text, count_a), np.repeat(text, count_b)
        size_a, size_b = a_side.table.size[ids_a], b_side.table.size[ids_b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        at_a, at_b = overlaps(text_a, end_a - size_a, text_b, end_b - size_b)
        doc = owner[text_a[at_a]]
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        last_a, last_b = np.diff(group_a, append=len(shared)) > 0, np.diff(group_b, append=len(shared)) > 0
        self.n = np.stack([np.bincount(x, minlength=documents) for x in (owner[text_a], owner[text_b], owner[text_a[last_a]], doc)])
        #: Sorted (document, pair) keys and how often each is linked.
        self.pairs, self.times = np.unique((doc << PAIR_BITS) + ids_a[at_a].astype(np.int64) * len(b_side.table.size) + ids_b[at_b], return_counts=True)
        # Group lists: a's ids, then b's, group by group.
        place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
        number, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.empty(len(ids_a) + len(ids_b), np.uint8)
        number[place_a], number[place_b] = ids_a, ids_b
        mark[place_a], mark[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        self.listing, ends = names.gather(number)
        self.listing[ends - 1] = mark
        self.owner, self.bounds = owner, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count_a + count_b)])]


def _parts(text: str) -> list[str]:
    """A long text in parts of some PART bytes that leave out one space
    between letters or digits, where both sides begin a token whatever stands
    around.  Text without such spaces stays in one part."""
    out, start = [], 0
    for cut in re.finditer(r"(?<=[^\W_]) (?=[^\W_])", text):
        if cut.start() - start >= PART:
            out.append(text[start : cut.start()])
            start = cut.end()
    return [*out, text[start:]]


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + BLOCK, "right")))
        yield batch.slice(start, stop - start)
        start = stop


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_ROW = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, places binary, times binary, codes array<long>, holders array<int>"
_ARROW = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("groups", pa.string()), ("places", pa.binary()), ("times", pa.binary()), ("codes", pa.list_(pa.int64())), ("holders", pa.list_(pa.int32()))]
)


def _aligner(a_path: str, b_path: str, with_groups: bool):
    """Rows of documents and, with ``codes``, a row for each block: its sorted
    pairs and how many of its documents hold each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side, names = _loaded(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for block in _blocks(batch):
                n = block.num_rows
                full = np.flatnonzero(pc.not_equal(block["text"], "").to_numpy(zero_copy_only=False))
                bad = np.ones(n, bool)
                bad[full] = False
                texts = block["text"].take(pa.array(full))
                if n == 1 and len(full) and len(texts[0].as_buffer()) > PART:
                    runs = [(pa.array([p]), np.zeros(1, np.int64)) for p in _parts(texts[0].as_py())]
                else:
                    runs = [(texts, full)]
                counts, lists = np.zeros((4, n), np.int64), [None] * n
                keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for own, owner in runs:
                    if len(own) == 0:
                        continue
                    found = Aligned(own, owner, n, a_side, b_side, names, bad)
                    counts += found.n
                    keys, where = np.unique(np.concatenate([keys, found.pairs]), return_inverse=True)
                    times = np.bincount(where, np.concatenate([times, found.times]), len(keys)).astype(np.int64)
                    for k, doc in enumerate(found.owner.tolist()):
                        listing = found.listing[found.bounds[k] : found.bounds[k + 1]]
                        if lists[doc] is None:
                            lists[doc] = [] if with_groups else hashlib.sha256()
                            listing = listing[:-1]
                        else:  # the semicolon of the part before
                            listing = np.concatenate([np.frombuffer(b";", np.uint8), listing[:-1]])
                        lists[doc].append(listing.tobytes()) if with_groups else lists[doc].update(listing)
                doc, code = keys >> PAIR_BITS, keys & ((1 << PAIR_BITS) - 1)
                good = ~bad[doc]
                doc, code, times = doc[good], code[good], times[good]
                counts[:, bad] = 0
                codes, place = np.unique(code, return_inverse=True)
                bounds = 4 * np.searchsorted(doc, np.arange(n + 1))
                blobs = [pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(x.astype("<u4").tobytes())]).cast(pa.binary()) for x in (place, times)]
                said = ["" if bad[k] or x is None else (b"".join(x).decode() if with_groups else x.hexdigest()) for k, x in enumerate(lists)]
                none = pa.nulls(n)
                columns = [pa.array(np.full(n, number)), block["doc_id"], *(pa.array(x) for x in counts), pa.array(said, pa.string()), *blobs, none.cast(_ARROW.field("codes").type), none.cast(_ARROW.field("holders").type)]
                yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)
                one = {"block": number, "codes": codes, "holders": np.bincount(place, minlength=len(codes)).astype(np.int32)}
                yield pa.RecordBatch.from_arrays([pa.array([one.get(f.name)], f.type) for f in _ARROW], schema=_ARROW)
                number += 1

    return rows


def _sums(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The sums over each document's links.  ``pairs`` are those of its block."""
    order = np.argsort(pairs["code"].to_numpy())
    count, best = pairs["holders"].to_numpy()[order], pairs["best"].to_numpy()[order]
    n_best, count_sum = [], []
    for place, times in zip(docs["places"].to_pylist(), docs["times"].to_pylist(), strict=True):
        at, often = np.frombuffer(place, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
        n_best.append(int(often[best[at]].sum()))
        count_sum.append(int((often * count[at]).sum()))
    return pa.table({**{c: docs[c] for c in ("doc_id", *_COUNTS)}, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups": docs["groups"]})


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", *, with_groups: bool = False) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum and groups_sha256, or with ``with_groups`` the list itself
    (``groups``): ``a1,a2|b1;a3|b2,b3``.

    ``a_path`` is a byte-level vocabulary, which gets a space before the text,
    ``b_path`` a piece model, which adds one; special tokens are plain text.  A
    pair's count is the number of rows of ``docs`` that hold it linked; repeated
    rows count each.  Null and empty texts, and texts that either side does not
    give back byte for byte, have no tokens: zeros and an empty list.  A null id
    stays null.  An empty table gives no rows.

    A document's pairs are kept as places, 8 bytes for each distinct one; a long
    text is aligned in parts.  Broadcast is a row for each id of ``a_path``.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = common.written(own.mapInArrow(_aligner(a_path, b_path, with_groups), _ROW), "alignment-rows")
    held = rows.where("codes is not null").select("block", F.inline(F.arrays_zip("codes", "holders"))).withColumnRenamed("codes", "code")
    counts = common.written(held.groupBy("code").agg(F.sum("holders").alias("holders")), "alignment-counts")
    first = F.floor(F.col("code") / F.lit(len(PieceLevel(b_path).table.size)))
    highest = counts.groupBy(first.alias("a")).agg(F.max("holders").alias("most"))
    judged = counts.join(F.broadcast(highest), first == F.col("a")).select("code", "holders", (F.col("holders") == F.col("most")).alias("best"))
    back = held.select("block", "code").join(judged, "code").select(F.col("block").alias("of_block"), "code", "holders", "best")
    texts = rows.where("codes is null").select("block", "doc_id", *_COUNTS, "groups", "places", "times")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    summed = texts.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(_sums, out)
    return summed if with_groups else summed.withColumnRenamed("groups", "groups_sha256")
