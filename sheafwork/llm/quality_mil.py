"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of a fixed number of words.  Each passage is
encoded from what its characters and repetitions count and from learned vectors
of its words and word pairs; gated attention weighs the encodings; the
weighted sum is scored.  Vectors, encoder, attention and scorer are learned
together from document labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the training sample: documents of each label, and passages of each,
#: evenly over the whole text.
SAMPLE_DOCS = 1500
SAMPLE_PASSAGES = 64
#: Hashed words, as many hashed word pairs, and the length of their vectors.
CODES = 1 << 12
CODE_WIDTH = 8
PASSAGE_WORDS = 48
#: Bytes of text that are encoded at a time, each in some 78 bytes of working memory.
_SLICE_BYTES = 250_000
_M = np.uint64(0x9E3779B97F4A7C15)

_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".", b",", b"!", b"?", b"|", b"#", b"$", b"%", b"&", b"*", b"@", b":;", b"\"'()-", b"<>=/\\_{}[]~^`+"]
_CLASS = np.full(256, len(_GROUPS), np.uint8)  # other bytes: mostly parts of accented letters
for _k, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _k
_N_CLASS = len(_GROUPS) + 1
N_FEATURES = _N_CLASS + 6


@dataclass
class Passages:
    """Passages of some texts, end to end: figures of each, passages of each
    text, words of each passage, and two codes of each word (it, and it with
    the next one of its passage)."""

    x: np.ndarray
    passages: np.ndarray
    words: np.ndarray
    codes: np.ndarray

    def take(self, at: np.ndarray, passages: np.ndarray) -> Passages:
        """The passages ``at``, as texts of so many ``passages`` each."""
        first = np.cumsum(self.words) - self.words
        size = self.words[at]
        own = np.arange(size.sum()) + np.repeat(first[at] - (np.cumsum(size) - size), size)
        return Passages(self.x[at], passages, size, self.codes[own])


def encode_passages(texts: pa.Array) -> Passages:
    """A text without words is one empty passage.  Null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    kind = _CLASS[data]
    space = (kind == 3) | (kind == 4)
    begins = ~space
    begins[1:] &= space[:-1] | np.isin(np.arange(1, len(data)), bounds, assume_unique=False) if n > 1 else space[:-1]
    starts = np.flatnonzero(begins)
    owner = np.searchsorted(bounds, starts, "right") - 1
    words = np.bincount(owner, minlength=n)
    first_word = np.cumsum(words) - words
    in_doc = np.arange(len(starts)) - first_word[owner]
    passages = np.maximum(-(-words // PASSAGE_WORDS), 1)
    first = np.cumsum(passages) - passages
    total = int(passages.sum())
    word_passage = first[owner] + in_doc // PASSAGE_WORDS
    # A byte belongs to the passage of the last word that began before it, else to its text's first.
    mark = np.zeros(len(data) + 1, np.int64)
    heads = np.flatnonzero((in_doc % PASSAGE_WORDS == 0) & (in_doc > 0))
    mark[starts[heads]] = 1
    step = np.cumsum(mark[:-1])
    text_of = np.repeat(np.arange(n), np.diff(bounds))
    extra = np.concatenate([[0], step])[bounds[:-1]] if len(data) else np.zeros(n, np.int64)
    byte_passage = first[text_of] + step - extra[text_of]
    counts = np.bincount(byte_passage * _N_CLASS + kind, minlength=total * _N_CLASS).reshape(total, _N_CLASS).astype(np.float32)
    size = np.maximum(counts.sum(1, keepdims=True), 1)
    n_words = np.bincount(word_passage, minlength=total).astype(np.float32)
    # Words and word triples by hash: how many are new to the passage, and to the text.
    powers = data.astype(np.uint64) + np.uint64(1)
    powers[space] = 0
    sums = np.concatenate([[np.uint64(0)], np.cumsum(powers * _M ^ (powers << np.uint64(17)), dtype=np.uint64)])
    edge = np.append(starts[1:], len(data)) if len(starts) else starts
    size_w = np.diff(np.append(np.cumsum(~space)[starts] - 1, (~space).sum())) if len(starts) else np.zeros(0, np.int64)
    lead = data[starts].astype(np.uint64) << np.uint64(40)
    code = (sums[edge] - sums[starts] + lead) * _M + size_w.astype(np.uint64)
    code ^= code >> np.uint64(29)

    def fresh(codes: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Is it the first of its kind in its group?"""
        order = np.argsort(codes + groups.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), kind="stable")
        key = (codes + groups.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[order]
        new = np.ones(len(codes), bool)
        new[order[1:]] = key[1:] != key[:-1]
        return new

    # The next word of the same passage, 0 for the last one.
    ahead = np.zeros(len(code), np.uint64)
    ahead[:-1] = np.where(word_passage[1:] == word_passage[:-1], code[1:], np.uint64(0))
    top = lambda h: (h * _M >> np.uint64(52)).astype(np.uint16)  # noqa: E731  CODES = 2^12
    codes = np.stack([top(code), top(code * np.uint64(3) + (ahead ^ ahead >> np.uint64(31)) * np.uint64(5)) + np.uint16(CODES)], 1) if len(code) else np.zeros((0, 2), np.uint16)
    new_word = fresh(code, word_passage)
    triple = code.copy()
    if len(code) > 2:
        triple[:-2] += (code[1:-1] << np.uint64(1)) * _M + (code[2:] << np.uint64(2)) * np.uint64(0x165667B19E3779F9)
    new_triple = fresh(triple, owner)
    share = lambda hit: np.bincount(word_passage, hit, total).astype(np.float32) / np.maximum(n_words, 1)
    letters = counts[:, 0] + counts[:, 1] + counts[:, -1]
    dense = [np.log1p(size[:, 0]) / 8, n_words / PASSAGE_WORDS, np.minimum(letters / np.maximum(n_words, 1) / 10, 3), share(new_word), share(new_triple), np.minimum(counts[:, 4] / np.maximum(n_words, 1) * 4, 4)]
    return Passages(np.concatenate([np.sqrt(counts / size), np.stack(dense, 1)], 1).astype(np.float32), passages, n_words.astype(np.int64), codes)


@dataclass
class MilModel:
    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]

    def forward(self, of: Passages) -> dict[str, np.ndarray]:
        p, passages = self.params, of.passages
        first = np.cumsum(passages) - passages
        bag = np.repeat(np.arange(len(passages)), passages)
        mean = np.zeros((len(of.x), CODE_WIDTH), p["e"].dtype)
        some = np.flatnonzero(of.words)
        if len(some):
            vectors = p["e"][of.codes[:, 0]] + p["e"][of.codes[:, 1]]
            mean[some] = np.add.reduceat(vectors, (np.cumsum(of.words) - of.words)[some], 0) / of.words[some, None]
        x = np.concatenate([(of.x - self.mean) / self.scale, mean], 1)
        h = np.tanh(x @ p["w"] + p["wb"])
        t, g = np.tanh(h @ p["v"] + p["vb"]), 1 / (1 + np.exp(-(h @ p["u"] + p["ub"])))
        raw = (t * g) @ p["a"]
        a = np.exp(raw - np.maximum.reduceat(raw, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, 0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["cb"], -30, 30)))}

    def gradient(self, of: Passages, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean cross-entropy, by parameter."""
        f, p, first = self.forward(of), self.params, np.cumsum(of.passages) - of.passages
        bag = f["bag"]
        dz = ((f["score"] - y) * weight / len(y))[:, None]
        grad = {"c": f["z"].T @ dz[:, 0], "cb": dz.sum()}
        dbag = dz * p["c"]
        inner = (f["h"] * dbag[bag]).sum(1)
        draw = f["a"] * (inner - np.add.reduceat(f["a"] * inner, first)[bag])
        gate = draw[:, None] * p["a"]
        dt, dg = gate * f["g"] * (1 - f["t"] ** 2), gate * f["t"] * f["g"] * (1 - f["g"])
        grad |= {"a": (f["t"] * f["g"]).T @ draw, "v": f["h"].T @ dt, "vb": dt.sum(0), "u": f["h"].T @ dg, "ub": dg.sum(0)}
        dh = (f["a"][:, None] * dbag[bag] + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
        grad |= {"w": f["x"].T @ dh, "wb": dh.sum(0), "e": np.zeros_like(p["e"])}
        if len(of.codes):
            share = (dh @ p["w"][-CODE_WIDTH:].T) / np.maximum(of.words, 1)[:, None]
            flat = of.codes.ravel()
            order = np.argsort(flat, kind="stable")
            start = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) > 0]))
            owner = np.repeat(np.arange(len(of.words)), of.words)
            grad["e"][flat[order][start]] = np.add.reduceat(share[owner[order // 2]], start, 0)
        return grad


def fit(docs: DataFrame, label: Column, text_col: str = "text", *, key: Column | None = None, sample_docs: int = SAMPLE_DOCS, **options) -> MilModel | None:
    """Learn from a bounded sample: of either label the ``sample_docs``
    documents with the least hash, of each SAMPLE_PASSAGES passages at most,
    evenly over the whole text.  ``label`` is 1 or 0; other rows are left out.
    Rows that are equal in key and text count once, so ties do not matter.
    What reaches the driver are the passages' features, not the texts.  None if
    a label has no document."""
    key = F.xxhash64(text_col) if key is None else F.xxhash64(key, F.col(text_col))
    own = docs.select(label.cast("int").alias("y"), F.col(text_col).cast("string").alias("text"), key.alias("key")).where("y in (0, 1)")
    return _fit(own.select("y", "key"), own.select("key", "text"), sample_docs, **options)


def fit_labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", *, sample_docs: int = SAMPLE_DOCS, **options) -> MilModel | None:
    """:func:`fit` with labels in a table of their own (id_col, label_col): ids and
    hashes meet them, no text does."""
    coded = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    of = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    return _fit(coded.select("id", "key").join(of, "id").select("y", "key"), coded.select("key", "text"), sample_docs, **options)


def _fit(known: DataFrame, texts: DataFrame, sample_docs: int, steps: int = 400, width: int = 24, seed: int = 5) -> MilModel | None:
    """From (y, key) of labelled documents and (key, text) of all."""
    last = {}
    for k in (0, 1):
        keys = known.where(F.col("y") == k).select("key").distinct().orderBy("key").limit(sample_docs)
        last[k] = keys.agg(F.max("key")).first()[0]
    if None in last.values():
        return None
    # 2 * sample_docs keys at most, to which the texts come by broadcast.
    chosen = known.where(((F.col("y") == 0) & (F.col("key") <= last[0])) | ((F.col("y") == 1) & (F.col("key") <= last[1]))).distinct()
    part = texts.where(F.col("key") <= max(last.values())).join(F.broadcast(chosen), "key")
    part = part.groupBy("y", "key").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch, "text"):
                of = encode_passages(piece["text"])
                blobs, first = [], np.cumsum(of.passages) - of.passages
                for at, n in zip(first.tolist(), of.passages.tolist(), strict=True):
                    some = at + np.unique(np.linspace(0, n - 1, min(n, SAMPLE_PASSAGES)).round().astype(np.int64))
                    own = of.take(some, np.array([len(some)]))
                    blobs.append((own.x.tobytes(), own.words.astype("<i8").tobytes(), own.codes.tobytes()))
                columns = [pa.array([b[k] for b in blobs], pa.binary()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([piece["y"], piece["key"], *columns], names=["y", "key", "x", "words", "codes"])

    rows = part.mapInArrow(features, "y int, key long, x binary, words binary, codes binary").collect()  # 2 * sample_docs at most
    rows.sort(key=lambda r: (r["y"], r["key"]))
    every = lambda c, kind: np.frombuffer(b"".join(bytes(r[c]) for r in rows), kind)
    counts = np.array([len(r["words"]) // 8 for r in rows])
    of = Passages(every("x", np.float32).reshape(-1, N_FEATURES), counts, every("words", np.int64), every("codes", np.uint16).reshape(-1, 2))
    return _train(of, np.array([r["y"] for r in rows], float), steps, width, seed)


def new_model(of: Passages, width: int, draw: np.random.Generator) -> MilModel:
    half = width // 2
    size = {"e": (2 * CODES, CODE_WIDTH), "w": (of.x.shape[1] + CODE_WIDTH, width), "wb": (width,), "v": (width, half), "vb": (half,), "u": (width, half), "ub": (half,), "a": (half,), "c": (width,), "cb": ()}
    params = {k: draw.normal(0, 1 / np.sqrt(s[0]), s) if k in "ewvuac" and s else np.zeros(s) for k, s in size.items()}
    return MilModel(of.x.mean(0, dtype=np.float64), of.x.std(0, dtype=np.float64) + 1e-2, params)


def _train(of: Passages, y: np.ndarray, steps: int, width: int, seed: int) -> MilModel:
    draw = np.random.default_rng(seed)
    model = new_model(of, width, draw)
    params = model.params
    m, v = ({k: np.zeros_like(p) for k, p in params.items()} for _ in range(2))
    bounds = np.concatenate([[0], np.cumsum(of.passages)])
    # Weights halfway between even labels and none, so that good documents are not lost to the rarer label.
    weight = np.where(y == 1, np.sqrt(0.5 / max(y.mean(), 1e-9)), np.sqrt(0.5 / max(1 - y.mean(), 1e-9)))
    for step in range(1, steps + 1):
        pick = draw.choice(len(y), min(256, len(y)), replace=False)
        at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in pick])
        grad = model.gradient(of.take(at, of.passages[pick]), y[pick], weight[pick])
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g + 1e-4 * params[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            params[k] = params[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    # Put one half where the fewest training documents fall on the wrong side, amid the widest such gap.
    logits = model.forward(of)["z"] @ params["c"] + params["cb"]
    order = np.argsort(logits, kind="stable")
    ranked = np.concatenate([[logits[order[0]] - 2], logits[order], [logits[order[-1]] + 2]])
    wrong = np.concatenate([[0], np.cumsum(y[order])]) + (len(y) - y.sum()) - np.concatenate([[0], np.cumsum(1 - y[order])])
    gap = np.where(wrong == wrong.min(), np.diff(ranked), -1)
    at = int(gap.argmax())
    params["cb"] = params["cb"] - (ranked[at] + ranked[at + 1]) / 2
    params["e"] = params["e"].astype(np.float32)
    return model


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + _SLICE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def score(docs: DataFrame, model: MilModel | None, *keep: Column | str, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and score (0 to 1), predicted (1 from 0.5 on),
    n_passages, top_passage (the one with most attention, from 0).

    Only the text is read for a score.  A text that is empty or null is one
    empty passage.  Without a model (a label has no document) the score is 0.5.
    """
    own = docs.select(*keep, F.col(text_col).cast("string").alias("_mil_text"))
    kept = own.columns[:-1]
    schema = own.drop("_mil_text").schema.add("score", "double").add("predicted", "integer").add("n_passages", "long").add("top_passage", "long")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "_mil_text"):
                of = encode_passages(part["_mil_text"])
                passages = of.passages
                value, top = np.full(part.num_rows, 0.5), np.zeros(part.num_rows, np.int64)
                if model is not None:
                    f = model.forward(of)
                    value, first = f["score"].astype(np.float64), np.cumsum(passages) - passages
                    order = np.lexsort((np.arange(len(of.x)), -f["a"], f["bag"]))
                    top = order[first] - first
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array(passages.astype(np.int64)), pa.array(top)], names=[*kept, "score", "predicted", "n_passages", "top_passage"])

    return own.mapInArrow(rows, schema)
