"""Exact tokenisation of whole texts in bulk.

Both public vocabularies split a text before they merge, so a text's ids are
those of its pieces in order.  Pieces repeat, so each task encodes a distinct
piece once and looks the rest up.  The cache is bounded and only saves time.
Texts that hold an added token of the vocabulary are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces that a worker remembers; when full, it starts anew.
CACHE_PIECES = 900_000
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 8_000_000

#: A stop or comma after a letter always begins a new token.
_STOP = "([a-z])([.,])"
#: The byte alphabet of byte-level vocabularies: printable bytes stand for
#: themselves, the others for the code points from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class BulkEncoder:
    """Encodes arrays of texts.  ``leading_space`` is true for byte-level
    vocabularies, where a space belongs to the word after it, and false for
    vocabularies that drop white space and case."""

    def __init__(self, path: str, leading_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A space after other white space may join it in one token; \x01 marks cuts.
        whole = [*added, *([r"[\s\x1c-\x1f\x{85}\p{Z}] ", r"\x01"] if leading_space else [])]
        self.whole = "(?i)" + "|".join(whole) if whole else None
        self.leading_space = leading_space
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.pool = array("I")
        self.ends = array("q", [0])

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, pieces: list[str]) -> None:
        """Encode pieces that the cache lacks.  A word of lower-case Latin
        letters needs no normalising or splitting: it goes to the merge table
        in the vocabulary's byte alphabet.  The others take the whole way."""
        place, pool, ends, tokenize = self.place, self.pool, self.ends, self.tokenizer.model.tokenize
        spaced, hard = self.leading_space, []
        for piece in pieces:
            word = piece[1:] if spaced and piece[0:1] == " " else piece
            if word.isalpha() and (spaced or word.islower()) and (word.isascii() or max(word) < "\u0250"):
                own = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
                pool.extend([t.id for t in tokenize(own if word is piece else "\u0120" + own)])
                ends.append(len(pool))
                place[piece] = len(place)
            else:
                hard.append(piece)
        for piece, ids in zip(hard, self._whole(hard), strict=True):
            pool.extend(ids)
            ends.append(len(pool))
            place[piece] = len(place)

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Cache places of distinct pieces."""
        if len(self.place) > CACHE_PIECES:
            self._clear()
        missing = list(filterfalse(self.place.__contains__, pieces))
        if missing:
            self._add(missing)
        return np.fromiter(map(self.place.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, ids per text).  Texts must not be null."""
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # Texts that go in whole.
        odd = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False) if self.whole else None
        if self.leading_space:
            pieces = pc.split_pattern(pc.replace_substring_regex(texts, _STOP, "\\1 \x01\\2"), " ")
        else:
            pieces = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), _STOP, r"\1 \2"))
        flat = pieces.flatten()
        coded = flat.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        at = coded.indices.to_numpy()
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False), out=bounds[1:])
        if self.leading_space:
            first = bounds[:-1][bounds[:-1] < bounds[1:]]
            plain = np.zeros(len(distinct), bool)
            plain[at[first]] = True
            spaced = np.ones(len(at), bool)
            spaced[first] = False
            wanted = [d for d, p in zip(distinct, plain, strict=True) if p]
            places = self._places([*wanted, *(d[1:] if d[:1] == "\x01" else " " + d for d in distinct)])
            own = np.zeros(len(distinct), np.int64)
            own[plain] = places[: len(wanted)]
            where = np.where(spaced, places[len(wanted) :][at], own[at])
        else:
            where = self._places(distinct)[at]
        pool, all_ends = np.array(self.pool, np.uint32), np.array(self.ends, np.int64)
        starts = all_ends[where]
        lengths = all_ends[where + 1] - starts
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
        before = np.concatenate([[0], ends])[bounds]
        counts = np.diff(before)
        if odd is not None and odd.any():
            parts = [ids[before[k] : before[k + 1]] for k in range(len(texts))]
            bad = np.flatnonzero(odd)
            for k, own_ids in zip(bad, self._whole(texts.take(pa.array(bad)).to_pylist()), strict=True):
                parts[k] = np.array(own_ids, np.uint32)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text's, and each text's bounds."""
    bounds = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(bounds[-1], end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, bounds


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch of about ``size`` bytes of text; a longer text stands alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


_ENCODERS: dict[tuple[str, bool], BulkEncoder] = {}


def encoder(path: str, leading_space: bool) -> BulkEncoder:
    """The worker's encoder for this vocabulary file."""
    key = (path, leading_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = BulkEncoder(path, leading_space)
    return _ENCODERS[key]
