"""Fill-in-the-middle rewriting; cuts are found with a wavelet matrix over
character classes.

A text is cut between units, by default runs of ASCII letters and single other
characters.  Each byte gets a class that knows whether the byte before
was a letter, and the classes of a slice of texts form one wavelet matrix: three
levels of bits with rank directories.  The number of units that begin before
a byte is a sum of class ranks; both cuts of all texts are found by bisection
on that sum, and numbers of characters are sums of ranks too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import slices

#: Byte classes.
INNER, FIRST, DIGIT, SPACE, OTHER, WIDE, TAIL = range(7)
_LEVELS = 3
#: Classes that begin a unit, and classes that begin a character.
UNITS, CHARACTERS = (FIRST, DIGIT, SPACE, OTHER, WIDE), (INNER, FIRST, DIGIT, SPACE, OTHER, WIDE)


class WaveletMatrix:
    """Ranks of symbols below ``2 ** levels`` in a sequence.

    Level by level from the highest bit, symbols are sorted stably by the bit;
    a level keeps its bits in words of 64 and the ones before each word.  It
    takes some ``levels / 4`` bytes a symbol, and while it is built two more.
    """

    def __init__(self, symbols: np.ndarray, levels: int = _LEVELS):
        self.size, self.levels = len(symbols), []
        for level in range(levels - 1, -1, -1):
            ones = ((symbols >> level) & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(packed) // 8 + 2, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.levels.append((level, words, before, self.size - int(before[-1])))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & below)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each position."""
        low, high = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for level, words, before, zeros in self.levels:
            left, right = self._ones(words, before, low), self._ones(words, before, high)
            low, high = (left + zeros, right + zeros) if symbol >> level & 1 else (low - left, high - right)
        return high - low

    def count(self, symbols: Sequence[int], at: np.ndarray) -> np.ndarray:
        """How many of ``symbols`` stand before each position."""
        return sum((self.rank(s, at) for s in symbols), np.zeros(len(at), np.int64))

    def locate(self, symbols: Sequence[int], low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """In each range, the last position with at most ``wanted`` of
        ``symbols`` between ``low`` and it, by bisection on ranks."""
        low, high, most = low.copy(), high.copy(), self.count(symbols, low) + wanted
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self.count(symbols, middle) <= most
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def _table() -> np.ndarray:
    of = np.full(256, OTHER, np.uint8)
    for chars, name in ((b"0123456789", DIGIT), (b" \t\n\v\f\r", SPACE), (bytes(range(128, 192)), TAIL), (bytes(range(192, 256)), WIDE)):
        of[list(chars)] = name
    letters = np.arange(256, dtype=np.uint8) | 32
    of[(letters >= 97) & (letters <= 122) & (np.arange(256) < 128)] = INNER
    return of


_CLASS = _table()


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte; at ``starts`` a text begins."""
    own = _CLASS[data]
    first = own == INNER
    first[1:] &= own[:-1] != INNER
    at = starts[starts < len(own)]
    first[at] = own[at] == INNER
    own[first] = FIRST
    return own


_FORMS = ("plain", "psm", "spm")
_OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _rewrite(markers: tuple[str, str, str], rate: int, spm_rate: int):
    p, s, m = (x.encode() for x in markers)

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part["text"].cast(pa.large_string())
                bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
                data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
                starts, ends = bounds[:-1] - bounds[0], bounds[1:] - bounds[0]
                matrix = WaveletMatrix(classes(data, starts))
                h1, h2, h3, h4 = (part[f"h{k}"].to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4))
                n = matrix.count(UNITS, ends) - matrix.count(UNITS, starts)
                one, two = h1 % (n + 1), h2 % (n + 1)
                low = matrix.locate(UNITS, starts, ends, np.minimum(one, two))
                high = matrix.locate(UNITS, starts, ends, np.maximum(one, two))
                marked = np.zeros(len(texts), bool)
                for marker in markers:
                    marked |= pc.match_substring(texts, marker).to_numpy(zero_copy_only=False)
                plain = (starts == ends) | marked | (h3 % 100 >= rate)
                form = np.where(plain, 0, np.where(h4 % 100 < spm_rate, 2, 1))
                chars = [matrix.count(CHARACTERS, at) for at in (starts, low, high)]
                raw, out = memoryview(data), []
                for a, b, c, d, f in zip(starts.tolist(), low.tolist(), high.tolist(), ends.tolist(), form.tolist(), strict=True):
                    pieces = (raw[a:d],) if f == 0 else (p, raw[a:b], s, raw[c:d], m, raw[b:c]) if f == 1 else (s, raw[c:d], p, raw[a:b], m, raw[b:c])
                    out.append(b"".join(pieces))
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        pa.array(n),
                        pa.array(np.array(_FORMS, object)[form], pa.string()),
                        pa.array(chars[1] - chars[0], mask=plain),
                        pa.array(chars[2] - chars[1], mask=plain),
                        pa.array(out, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return rewritten


MARKERS = ("<P>", "<S>", "<M>")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, markers: tuple[str, str, str] = MARKERS, seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """A row per document: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``rate`` of a hundred documents are rewritten, ``spm_rate`` of a hundred of
    these with the suffix first.  Cuts and forms follow from ``seed`` and the id
    alone; both cuts lie between units, ends included.  A null text counts as
    empty; empty texts and those that hold a marker stay plain.  A null id is
    drawn like an empty one.  Repeated rows give repeated rows; an empty table
    gives none.  A slice of texts takes some 6 bytes a byte of text, and a text
    longer than a slice is one by itself.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *draws)
    return own.mapInArrow(_rewrite(markers, rate, spm_rate), _OUT)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made from.  Texts that hold a marker are plain,
    so the first marker of each kind is the one that was put in."""
    p, s, m = markers

    def rebuilt(lead: str, second: str, prefix_first: bool) -> Column:
        body = F.substring(output, F.lit(len(lead) + 1), F.length(output))
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + len(second) + 1, F.length(body))
        two = F.substring_index(rest, m, 1)
        middle = F.substring(rest, F.length(two) + len(m) + 1, F.length(rest))
        return F.concat(one, middle, two) if prefix_first else F.concat(two, middle, one)

    return F.when(form == "psm", rebuilt(p, s, True)).when(form == "spm", rebuilt(s, p, False)).otherwise(output)
