"""Language identification by a linear-chain conditional random field.

Every word of a text gets a distribution over languages by forward-backward;
a document's language is the one with the largest expected number of words.
Word scores come from hashed byte n-grams, affixes and a learned lexicon, and
the transitions are learned too.  Training chains are spliced from segments of
documents of known language, so that switching is seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bounds of the training sample: documents of each language, words of each, and
#: documents of all; with many languages each gives fewer, one at least.
SAMPLE_DOCS = 300
SAMPLE_WORDS = 200
SAMPLE_ALL = 64 * SAMPLE_DOCS
#: Words of a block; messages are carried from block to block of a text.
BLOCK = 64
#: Words from which a chain's blocks are multiplied out at once, and the labels up
#: to which n times the work for a word is less than a step for each word.
LONG, FEW_LABELS = 64 * BLOCK, 40
_GRAM_BITS, _LEX_BITS = 16, 18
_SLICE_BYTES = 4_000_000
#: Chains and words that are scored at a time.
_CHAINS, _WORDS = 4096, 20_000
_M = np.uint64(0x9E3779B97F4A7C15)
#: Salts of the features: inner n-grams, prefixes, suffixes.
_SALTS = {(kind, n): np.uint64(1000 * k + n) for k, kind in enumerate(("gram", "prefix", "suffix")) for n in (1, 2, 3, 4)}


def _at_a_time(most: int, languages: int) -> int:
    """``most``, or less where there are so many languages that memory counts."""
    return max(1, most * 64 // max(languages, 64))


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    h = h * _M
    h ^= h >> np.uint64(32)
    h *= _M
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def letters_only(texts: pa.Array) -> pa.Array:
    """Lower case, every run of anything but letters a space; null is empty."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " ")


class WordFeatures:
    """Hashed features of an array of distinct words, all of one word together
    by position: words are laid out end to end between boundary bytes."""

    def __init__(self, words: pa.Array):
        words = words.cast(pa.large_string())
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], np.int64, n + 1, words.offset * 8)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
        length = np.diff(offsets)
        # ^word$: one boundary byte on either side.
        self.start = np.concatenate([[0], np.cumsum(length + 2)])[:-1]
        self.size = length + 2
        owner = np.repeat(np.arange(n), length)
        line = np.full(int((length + 2).sum()) + 4, 1, np.uint64)
        inner = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], length)
        line[self.start[owner] + 1 + inner] = data
        total = len(line) - 4
        powers = np.cumprod(np.concatenate([[1], np.full(64, int(_M) | 1, np.uint64)]).astype(np.uint64))
        hashed = (data + np.uint64(7)) * powers[np.minimum(inner, 64)]
        hashed = hashed + np.uint64(0x100000001B3) * inner.astype(np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashed, dtype=np.uint64)])
        at = offsets - offsets[0]
        self.word = _bucket(sums[at[1:]] - sums[at[:-1]], _LEX_BITS)
        grams = []
        two = line[:-1] << np.uint64(8) | line[1:]
        three = two[:-1] << np.uint64(8) | line[2:]
        four = three[:-1] << np.uint64(8) | line[3:]
        ends = np.repeat(self.start + self.size, self.size)
        place = np.arange(total)
        for k, g in ((2, two), (3, three), (4, four)):
            b = _bucket(g[:total] << np.uint64(12) | _SALTS["gram", k], _GRAM_BITS)
            grams.append(np.where(place + k <= ends, b, 1 << _GRAM_BITS))  # the last row of weights stays 0
        self.grams = np.stack(grams, 1)
        last = self.start + self.size - 1
        affixes = []
        for k, g in ((1, line), (2, two), (3, three)):
            ok = length >= k
            affixes.append(np.where(ok, _bucket(g[self.start + 1] << np.uint64(12) | _SALTS["prefix", k], _GRAM_BITS), 1 << _GRAM_BITS))
            affixes.append(np.where(ok, _bucket(g[np.maximum(last - k, 0)] << np.uint64(12) | _SALTS["suffix", k], _GRAM_BITS), 1 << _GRAM_BITS))
        self.affixes = np.stack(affixes, 1)

    def scores(self, weights: np.ndarray, lexicon: np.ndarray, lex_weights: np.ndarray) -> np.ndarray:
        """(words, languages)"""
        out = np.zeros((len(self.start), weights.shape[1]), weights.dtype)
        for a in range(0, len(out), _WORDS):
            at = self.start[a : a + _WORDS]
            g = self.grams[at[0] : at[-1] + self.size[a + len(at) - 1]]
            out[a : a + _WORDS] = np.add.reduceat(weights[g[:, 0]] + weights[g[:, 1]] + weights[g[:, 2]], at - at[0], 0)
        for k in range(self.affixes.shape[1]):
            out = out + weights[self.affixes[:, k]]
        return out + lexicon[self.word] @ lex_weights


def forward_backward(scores: np.ndarray, move: np.ndarray, start: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of (chains, steps, labels) scores, and expected transitions.

    ``move`` and ``start`` are log weights; ``mask`` is false past a chain's end.
    """
    chains, steps, n = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True))
    e[~mask] = 1.0
    a = np.exp(move)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    now = e[:, 0] * np.exp(start)
    alpha[:, 0] = now / now.sum(1, keepdims=True)
    for t in range(1, steps):
        now = (alpha[:, t - 1] @ a) * e[:, t]
        now /= now.sum(1, keepdims=True)
        alpha[:, t] = np.where(mask[:, t, None], now, alpha[:, t - 1])
    beta[:, -1] = 1.0 / n
    pairs = np.zeros((n, n))
    for t in range(steps - 2, -1, -1):
        ahead = e[:, t + 1] * beta[:, t + 1]
        now = ahead @ a.T
        own = alpha[:, t, :, None] * a * ahead[:, None, :]
        own /= own.sum((1, 2), keepdims=True)
        pairs += own[mask[:, t + 1]].sum(0)
        now /= now.sum(1, keepdims=True)
        beta[:, t] = np.where(mask[:, t + 1, None], now, 1.0 / n)
    post = alpha * beta
    return post / post.sum(2, keepdims=True), pairs


def posteriors(scores: np.ndarray, counts: np.ndarray, move: np.ndarray, start: np.ndarray, width: int = _CHAINS) -> np.ndarray:
    """As :func:`forward_backward`, without the transitions, for many chains of
    any length: ``scores`` (words, labels) has them end to end, ``counts`` their
    lengths.  Chains go in blocks of BLOCK words, ``width`` blocks at a time:
    all first blocks, then all second ones with the messages of the first, and
    back again; so memory is that of the scores, however long a chain is.  A
    chain of more than LONG words goes by :func:`_all_blocks`, where labels are
    so few that this is less work.
    """
    n = scores.shape[1]
    e = np.exp(scores - scores.max(1, keepdims=True, initial=-np.inf))
    a = np.exp(move).astype(e.dtype)
    at_start = np.exp(start - start.max()).astype(e.dtype)
    post = np.empty_like(e)
    first = np.cumsum(counts) - counts
    alone = np.flatnonzero(counts > LONG) if n <= FEW_LABELS else np.zeros(0, np.int64)
    for k in alone.tolist():
        post[first[k] : first[k] + counts[k]] = _all_blocks(e[first[k] : first[k] + counts[k]], a, at_start)
    counts = np.where(np.isin(np.arange(len(counts)), alone), 0, counts)
    # The longest chains first, so that those that go on are a prefix.
    order = np.argsort(-counts, kind="stable")
    long = counts[order]
    steps = [(k, own) for k in range(0, int(counts.max(initial=0)), BLOCK) for own in _parts_of(int(np.searchsorted(-long, -k, "left")), width)]

    def grid(k: int, own: slice) -> tuple[np.ndarray, np.ndarray]:
        """Places of the block's words, and which are there."""
        t = np.arange(k, k + BLOCK)
        there = t[None, :] < long[own, None]
        return np.where(there, first[order[own], None] + t[None, :], 0), there

    now = np.tile(at_start, (len(counts), 1))
    for k, own in steps:
        place, there = grid(k, own)
        alpha = now[own]
        for t in range(int(there.any(0).sum())):
            moved = alpha if k + t == 0 else alpha @ a
            new = moved * e[place[:, t]]
            alpha = np.where(there[:, t, None], new / new.sum(1, keepdims=True), alpha)
            post[place[there[:, t], t]] = alpha[there[:, t]]
        now[own] = alpha
    now = np.ones((len(counts), n), e.dtype)
    for k, own in reversed(steps):
        place, there = grid(k, own)
        beta = now[own]
        for t in reversed(range(int(there.any(0).sum()))):
            here = there[:, t]
            post[place[here, t]] *= beta[here]
            new = (e[place[:, t]] * beta) @ a.T
            beta = np.where(here[:, None], new / new.sum(1, keepdims=True), beta)
        now[own] = beta
    return post / post.sum(1, keepdims=True)


def _all_blocks(e: np.ndarray, a: np.ndarray, at_start: np.ndarray) -> np.ndarray:
    """Forward times backward messages of one long chain, all its blocks at once.

    The matrices of all words of a block are multiplied, for all blocks in step;
    a scan over the blocks, a product each, gives the messages that enter each
    block from either side; then all blocks run in step from these.
    """
    words, n = e.shape
    blocks = -(-words // BLOCK)
    there = (np.arange(blocks * BLOCK) < words).reshape(blocks, BLOCK)
    grid = np.ones((blocks * BLOCK, n), np.float64)
    grid[:words] = e
    grid, a = grid.reshape(blocks, BLOCK, n), a.astype(np.float64)
    whole = np.tile(np.eye(n), (blocks, 1, 1))
    for t in range(BLOCK):
        moved = whole @ a
        if t == 0:
            moved[0] = whole[0]  # nothing comes before the first word
        new = moved * grid[:, t, None, :]
        whole = np.where(there[:, t, None, None], new / new.max((1, 2), keepdims=True), whole)
    left, right = np.empty((blocks, n)), np.ones((blocks, n))
    left[0] = at_start
    for k in range(1, blocks):
        now = left[k - 1] @ whole[k - 1]
        left[k] = now / now.sum()
    for k in range(blocks - 1, 0, -1):
        now = whole[k] @ right[k]
        right[k - 1] = now / now.sum()
    out = np.empty_like(grid)
    for t in range(BLOCK):
        moved = left @ a
        if t == 0:
            moved[0] = left[0]
        new = moved * grid[:, t]
        left = np.where(there[:, t, None], new / new.sum(1, keepdims=True), left)
        out[:, t] = left
    for t in reversed(range(BLOCK)):
        out[:, t] *= right
        new = (grid[:, t] * right) @ a.T
        right = np.where(there[:, t, None], new / new.sum(1, keepdims=True), right)
    return out.reshape(-1, n)[:words]


def _parts_of(n: int, width: int) -> list[slice]:
    return [slice(k, min(k + width, n)) for k in range(0, n, width)]


@dataclass
class CrfModel:
    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    lex_weights: np.ndarray
    move: np.ndarray
    start: np.ndarray


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, key: Column | None = None, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS, epochs: int = 6, seed: int = 11) -> CrfModel | None:
    """Learn from a bounded sample: of each language the ``sample_docs``
    documents with the least hash, of each a segment of ``sample_words`` words
    at a hashed place.  All languages are learned: if they are so many that
    SAMPLE_ALL documents would not do, each gives fewer.  Rows that are equal in
    key and text count once, so ties do not matter.  None if no row has a
    language and a word."""
    key = F.xxhash64(text_col) if key is None else F.xxhash64(key, F.col(text_col))
    words = F.array_remove(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "), " "), "")
    own = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), key.alias("key"))
    counted = common.written(own.groupBy("lang").count(), "languages")
    n_langs = counted.count()
    if not n_langs:
        return None
    sample_docs = min(sample_docs, max(1, SAMPLE_ALL // n_langs))
    # Keys are even, so of a language's documents about twice as many as wanted have a key up to this share of all.
    share = F.least(F.lit(1.0), (2 * sample_docs + 100) / F.col("count"))
    bound = counted.select("lang", (F.lit(-float(1 << 63)) + share * float(1 << 64)).alias("_bound"))
    few = own.join(F.broadcast(bound), "lang").where(F.col("key") <= F.col("_bound"))  # a row for each language
    # Equal documents have one key and count once; a bounded number of keys is ranked.
    first = Window.partitionBy("lang").orderBy("key")
    few = few.groupBy("lang", "key").agg(F.min("text").alias("text")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample_docs)
    start = F.pmod("key", F.greatest(F.size("words") - sample_words, F.lit(1))) + 1
    rows = few.select("lang", "key", words.alias("words")).select("lang", "key", F.slice("words", start.cast("int"), sample_words).alias("words")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["key"], r["words"]))
    return _train([r["words"] for r in rows], [r["lang"] for r in rows], epochs, seed)


def _train(texts: list[list[str]], langs: list[str], epochs: int, seed: int) -> CrfModel:
    languages = sorted(set(langs))
    n, draw = len(languages), np.random.default_rng(seed)
    coded = pa.array([w for t in texts for w in t], pa.string()).dictionary_encode()
    features = WordFeatures(coded.dictionary)
    word = coded.indices.to_numpy().astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    label = np.repeat([languages.index(x) for x in langs], np.diff(bounds))
    # Lexicon: smoothed log-odds of a word's language in the sample, none for unseen words.
    counts = np.zeros((1 << _LEX_BITS, n))
    np.add.at(counts, (features.word[word], label), 1.0)
    share = (counts + 0.5) / (counts.sum(0) + 0.5 * len(features.word))
    lexicon = np.log(share / share.mean(1, keepdims=True))
    lexicon[counts.sum(1) == 0] = 0.0
    lexicon = np.clip(lexicon, -3, 3).astype(np.float32)
    weights = np.zeros(((1 << _GRAM_BITS) + 1, n))
    lex_weights, move, start = 0.2 * np.eye(n), np.eye(n), np.zeros(n)
    sums = [np.full(x.shape, 1e-3) for x in (weights, lex_weights, move, start)]
    steps, width = 32, 256
    if n == 1:
        return CrfModel(languages, weights.astype(np.float32), lexicon, lex_weights.astype(np.float32), move, start)
    place_word = np.repeat(np.arange(len(features.start)), features.size)
    total = int(np.ceil(len(word) / (steps * width)))
    for _ in range(epochs * max(total, 1)):
        # Chains of one segment, half of them switching to another document once.
        doc = draw.integers(0, len(texts), (width, 2))
        cut = np.where(draw.random(width) < 0.5, draw.integers(4, steps - 3, width), steps)
        t = np.arange(steps)
        which = (t[None, :] >= cut[:, None]).astype(int)
        own = doc[np.arange(width)[:, None], which]
        size = np.diff(bounds)[own]
        at = bounds[own] + (draw.integers(0, 1 << 30, (width, 2))[np.arange(width)[:, None], which] + t[None, :]) % size
        x, y = word[at], label[at]
        used, local = np.unique(x, return_inverse=True)
        local = local.reshape(x.shape)
        emitted = features.scores(weights, lexicon, lex_weights)[used]
        post, pairs = forward_backward(emitted[local], move, start, np.ones(x.shape, bool))
        gold = np.zeros_like(post)
        np.put_along_axis(gold, y[..., None], 1.0, 2)
        error = gold - post
        by_word = np.zeros((len(features.start), n))
        for k in range(n):
            by_word[:, k] = np.bincount(x.ravel(), error[..., k].ravel(), len(by_word))
        grad = np.zeros_like(weights)
        for k in range(n):
            spread = by_word[:, k][place_word]
            for g in range(3):
                grad[:, k] += np.bincount(features.grams[:, g], spread, len(grad))
            for g in range(features.affixes.shape[1]):
                grad[:, k] += np.bincount(features.affixes[:, g], by_word[:, k], len(grad))
        grad[-1] = 0
        seen = np.zeros((n, n))
        np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
        first = np.bincount(y[:, 0], minlength=n) - post[:, 0].sum(0)
        for p, g, s in zip((weights, lex_weights, move, start), (grad, lexicon[features.word].T @ by_word, seen - pairs, first), sums, strict=True):
            g = g / width - 1e-4 * p
            s += g * g
            p += 0.3 * g / np.sqrt(s)
    return CrfModel(languages, weights.astype(np.float32), lexicon, lex_weights.astype(np.float32), move, start)


def _label(model: CrfModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each word, words per text, word codes) of a batch."""
    lists = pc.ascii_split_whitespace(letters_only(texts))
    flat = lists.flatten()
    real = pc.not_equal(flat, "")
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[real.to_numpy(zero_copy_only=False)]
    coded = flat.filter(real).dictionary_encode()
    counts = np.bincount(owner, minlength=len(texts))
    n = len(model.languages)
    if len(coded) == 0:
        return np.zeros((0, n), np.float32), counts, np.zeros(0, np.int64)
    scores = WordFeatures(coded.dictionary).scores(model.weights, model.lexicon, model.lex_weights)
    word = coded.indices.to_numpy()
    post = posteriors(scores[word], counts, model.move, model.start, _at_a_time(_CHAINS, n))
    return post, counts, word


def predict(docs: DataFrame, model: CrfModel | None, *keep: Column | str, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and lang_pred, score (the expected share of words in
    that language), n_words, n_switched (words labelled otherwise).

    A text that is null or has no letter is ``und`` with score 0.  Only the
    text is read for a prediction.  Equal shares go to the first language by
    name.  With no model (nothing to learn from), all are ``und``.
    """
    own = docs.select(*keep, F.col(text_col).cast("string").alias("_crf_text"))
    kept = own.columns[:-1]
    schema = own.drop("_crf_text").schema.add("lang_pred", "string").add("score", "double").add("n_words", "long").add("n_switched", "long")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_bytes = _at_a_time(_SLICE_BYTES, len(model.languages) if model else 0)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["_crf_text"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + slice_bytes, "right")))
                part = batch.slice(start, stop - start)
                start = stop
                k = part.num_rows
                langs, score, counts, other = np.full(k, "und", object), np.zeros(k), np.zeros(k, np.int64), np.zeros(k, np.int64)
                if model is not None:
                    post, counts, _ = _label(model, part["_crf_text"])
                    has = counts > 0
                    if has.any():
                        first = (np.cumsum(counts) - counts)[has]
                        total = np.add.reduceat(post.astype(np.float64), first, 0)
                        best = total.argmax(1)
                        langs[has] = np.array(model.languages, object)[best]
                        score[has] = np.clip(total.max(1) / counts[has], 0, 1)
                        other[has] = np.add.reduceat((post.argmax(1) != np.repeat(best, counts[has])).astype(np.int64), first)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.array(langs, pa.string()), pa.array(score), pa.array(counts.astype(np.int64)), pa.array(other)], names=[*kept, "lang_pred", "score", "n_words", "n_switched"])

    return own.mapInArrow(rows, schema)


def label_words(docs: DataFrame, model: CrfModel, *keep: Column | str, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``labels``: the likeliest language of each word
    (runs of letters) in order; null text has none."""
    own = docs.select(*keep, F.col(text_col).cast("string").alias("_crf_text"))
    kept = own.columns[:-1]
    schema = own.drop("_crf_text").schema.add("labels", T.ArrayType(T.StringType()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                post, counts, _ = _label(model, part["_crf_text"])
                names = pa.array(model.languages).take(pa.array(post.argmax(1) if len(post) else np.zeros(0, np.int64)))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.ListArray.from_arrays(offsets, names)], names=[*kept, "labels"])

    return own.mapInArrow(rows, schema)
