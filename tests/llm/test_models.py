"""Held-out accuracy of the two learned operators, and their odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafwork.llm import language_crf, quality_mil
from sheafwork.llm.queries import held_out


def test_languages_of_held_out_documents(docs, rows, empty):
    model = language_crf.fit(docs.where(~held_out()), key=F.col("doc_id"), epochs=4)
    got = {r["doc_id"]: r for r in language_crf.predict(docs, model, "doc_id", held_out().alias("held")).collect()}
    known = {r[0]: ("en", "de", "fr")[r[0] % 3] for r in rows if r[0] is not None and r[0] < 60}
    held = [k for k in known if got[k]["held"]]
    assert held and sum(got[k]["lang_pred"] == known[k] for k in held) / len(held) >= 0.95
    for k in (70, 71, 72):
        assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_crf.predict(empty, model, "doc_id").count() == 0
    assert language_crf.fit(empty) is None
    assert {r["lang_pred"] for r in language_crf.predict(docs, None, "doc_id").collect()} == {"und"}


def test_every_language_is_learned(spark):
    letters = "bcdfghklmnpqrstvwz"
    words = {f"l{k:02}": [letters[k % 18] + v + letters[k // 18] + w + letters[(k + 5) % 18] for v in "aeiou" for w in "aeiou"] for k in range(70)}
    rows = [(10 * k + j, " ".join(own[j:] + own[:j]), lang) for k, (lang, own) in enumerate(words.items()) for j in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_crf.fit(frame, key=F.col("doc_id"), epochs=30)
    assert model.languages == sorted(words)
    got = {r["doc_id"]: r["lang_pred"] for r in language_crf.predict(frame, model, "doc_id").collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_words_of_switched_text(spark, docs):
    model = language_crf.fit(docs.where(~held_out()), key=F.col("doc_id"), epochs=4)
    text = "the house and the river with their garden " * 2 + "der garten und das haus mit sich zu den von die und das " * 2
    labels = language_crf.label_words(spark.createDataFrame([(1, text)], "id long, text string"), model, "id").first()["labels"]
    assert len(labels) == len(text.split())
    assert labels[:12].count("en") >= 10 and labels[-12:].count("de") >= 10


@pytest.mark.parametrize("words", [1, 63, 64, 65, 300, 5000])
def test_blocks_at_once_equal_word_by_word(words, monkeypatch):
    draw = np.random.default_rng(words)
    scores, move, start = draw.normal(0, 3, (words + 20, 4)), draw.normal(0, 2, (4, 4)), draw.normal(0, 1, 4)
    counts = np.array([7, words, 13])
    monkeypatch.setattr(language_crf, "LONG", 10**9)
    want = language_crf.posteriors(scores, counts, move, start)
    monkeypatch.setattr(language_crf, "LONG", 0)
    assert np.allclose(language_crf.posteriors(scores, counts, move, start), want, atol=1e-9)


def test_forward_backward_equals_enumeration():
    import itertools

    draw = np.random.default_rng(0)
    scores, move, start = draw.normal(size=(1, 5, 3)), draw.normal(size=(3, 3)), draw.normal(size=3)
    mask = np.ones((1, 5), bool)
    want, pairs = np.zeros((5, 3)), np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=5):
        p = np.exp(start[path[0]] + sum(scores[0, t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path)))
        for t, y in enumerate(path):
            want[t, y] += p
        for a, b in itertools.pairwise(path):
            pairs[a, b] += p
    total = want[0].sum()
    post, moved = language_crf.forward_backward(scores, move, start, mask)
    np.testing.assert_allclose(post[0], want / total, atol=1e-9)
    np.testing.assert_allclose(moved, pairs / total, atol=1e-9)
    np.testing.assert_allclose(language_crf.posteriors(scores[0], np.array([5]), move, start), want / total, atol=1e-9)


def test_messages_cross_the_blocks():
    draw = np.random.default_rng(1)
    counts = np.array([3, 0, 64, 200, 1, 65, 129])
    scores, move, start = draw.normal(size=(counts.sum(), 4)), 3 * draw.normal(size=(4, 4)), draw.normal(size=4)
    got, at = language_crf.posteriors(scores, counts, move, start, width=2), 0
    for n in counts:
        if n:
            want, _ = language_crf.forward_backward(scores[None, at : at + n], move, start, np.ones((1, n), bool))
            np.testing.assert_allclose(got[at : at + n], want[0], atol=1e-9)
        at += n


def test_sample_is_bounded_and_ties_do_not_matter(spark):
    rows = [(None if k % 2 else 7, f"wort{k % 50} haus", "de") for k in range(2000)] + [(k, "the house", "en") for k in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [language_crf.fit(f, key=F.col("doc_id"), epochs=1, sample_docs=20) for f in (frame, frame.orderBy(F.desc("text")))]
    assert models[0].languages == ["de", "en"]
    np.testing.assert_array_equal(models[0].weights, models[1].weights)


def test_quality_of_held_out_documents(spark, empty):
    from .conftest import prose
    import random

    draw, rows = random.Random(2), []
    for k in range(240):
        text = prose(draw, ("en", "de", "fr")[k % 3], 30 + k % 90)
        good = draw.random() < 0.7
        rows.append((k, text if good else draw.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), " ".join(w + "###" for w in text.split())]), int(good)))
    frame = spark.createDataFrame([*rows, (900, None, None), (901, "", None)], "doc_id long, text string, quality int")
    model = quality_mil.fit(frame.where(~held_out()), F.col("quality"), key=F.col("doc_id"), steps=150)
    tables = frame.drop("quality").withColumn("id", F.lit(1)).withColumn("y", F.lit(2)), frame.select("doc_id", "quality")
    apart = quality_mil.fit_labelled(tables[0].where(~held_out()), tables[1], steps=150)
    assert all(np.array_equal(model.params[k], apart.params[k]) for k in model.params)
    got = {r["doc_id"]: r for r in quality_mil.score(frame, model, "doc_id", held_out().alias("held")).collect()}
    held = [r for r in rows if got[r[0]]["held"]]
    assert sum(got[r[0]]["predicted"] == r[2] for r in held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert got[900]["score"] == got[901]["score"] and got[900]["n_passages"] == 1
    assert quality_mil.score(empty, model, "doc_id").count() == 0
    assert quality_mil.fit(empty.withColumn("q", F.lit(1)), F.col("q")) is None
    assert quality_mil.score(frame, None, "doc_id").first()["score"] == 0.5


def test_quality_is_seen_in_words(spark):
    """Good and bad texts that differ in nothing but which words they use: no
    count of characters or repetitions tells them apart."""
    import random

    draw, rows = random.Random(4), []
    letters = "abcdefgh"
    stock = ["".join(draw.choice(letters) for _ in range(6)) for _ in range(400)]
    for k in range(300):
        good = k % 2
        rows.append((k, " ".join(draw.choice(stock[:200] if good else stock[200:]) for _ in range(60 + k % 100)), good))
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality_mil.fit(frame.where(~held_out()), F.col("quality"), key=F.col("doc_id"), steps=200)
    got = quality_mil.score(frame.where(held_out()), model, "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) >= 0.95


TEXTS = ["one two three. " * 40, "", None, "A! B? c " * 100 + "\n\n" + "x y", "é ü ß 中文 " * 30, "a b a b"]


def test_attention_gradient_equals_differences():
    import pyarrow as pa

    draw = np.random.default_rng(1)
    of = quality_mil.encode_passages(pa.array(TEXTS))
    of.x = of.x.astype(np.float64)
    model = quality_mil.new_model(of, 6, draw)
    y, weight = draw.integers(0, 2, len(TEXTS)).astype(float), draw.random(len(TEXTS)) + 0.5

    def loss():
        score = model.forward(of)["score"]
        return -(weight * (y * np.log(score) + (1 - y) * np.log(1 - score))).mean()

    grad = model.gradient(of, y, weight)
    for name, value in model.params.items():
        places = [()] if value.shape == () else [tuple(draw.integers(0, value.shape)) for _ in range(12)]
        if name == "e":
            places += [(int(c), k % 8) for k, c in enumerate(of.codes[:6].ravel())]
        for at in places:
            was = float(value[at])
            model.params[name] = value = np.array(value)
            value[at] = was + 1e-5
            above = loss()
            value[at] = was - 1e-5
            below = loss()
            value[at] = was
            assert abs((above - below) / 2e-5 - np.asarray(grad[name])[at]) < 1e-6, (name, at)


def test_forward_pass_matches_a_plain_one():
    import pyarrow as pa

    draw = np.random.default_rng(2)
    of = quality_mil.encode_passages(pa.array(TEXTS))
    model = quality_mil.new_model(of, 6, draw)
    p, got = model.params, model.forward(of)
    passage = word = 0
    for k, text in enumerate(TEXTS):
        words = (text or "").split()
        n = max(1, -(-len(words) // quality_mil.PASSAGE_WORDS))
        assert of.passages[k] == n
        hidden, raw = [], []
        for j in range(n):
            size = len(words[j * quality_mil.PASSAGE_WORDS : (j + 1) * quality_mil.PASSAGE_WORDS])
            assert of.words[passage] == size
            mean = sum((p["e"][a] + p["e"][b] for a, b in of.codes[word : word + size]), np.zeros(quality_mil.CODE_WIDTH)) / max(size, 1)
            h = np.tanh(np.concatenate([(of.x[passage] - model.mean) / model.scale, mean]) @ p["w"] + p["wb"])
            hidden.append(h)
            raw.append((np.tanh(h @ p["v"] + p["vb"]) / (1 + np.exp(-(h @ p["u"] + p["ub"])))) @ p["a"])
            passage, word = passage + 1, word + size
        weight = np.exp(raw) / np.exp(raw).sum()
        score = 1 / (1 + np.exp(-(sum(w * h for w, h in zip(weight, hidden, strict=True)) @ p["c"] + p["cb"])))
        assert abs(score - got["score"][k]) < 1e-9


def test_working_memory_of_a_large_batch_is_bounded():
    """Workers stay for the stages after, with what they once took."""
    import tracemalloc

    import pyarrow as pa

    draw = np.random.default_rng(3)
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(draw.choice(["one", "two.", "three,", "four"], 400)) for _ in range(2000)])], names=["text"])
    model = quality_mil.new_model(quality_mil.encode_passages(batch["text"].slice(0, 20)), 24, draw)
    tracemalloc.start()
    try:
        n = sum(len(model.forward(quality_mil.encode_passages(part["text"]))["score"]) for part in quality_mil._slices(batch, "text"))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 2000 and most < 60e6, most
