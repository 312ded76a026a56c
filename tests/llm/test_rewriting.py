"""Alignment, fill-in-middle and exact deduplication against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheafwork.llm import alignment, exact_dedup, fill_in_middle

A_PATH, B_PATH = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def sides():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {chr(x): x for x in printable}
    char |= {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in printable)}

    def tokens(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        other = b.encode(text)
        a_bytes = [bytes(char[c] for c in a.id_to_token(i)) for i in ids]
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in other]
        return (ids, a_bytes), (other, b_bytes)

    return tokens


def plain_alignment(texts):
    """By all pairs of tokens; (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    tokens, out, links = sides(), [], []
    for text in texts:
        (ia, ba), (ib, bb) = tokens(text) if text else (([], []), ([], []))
        if not text or b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
            out.append([0, 0, 0, 0, ""])
            links.append([])
            continue
        ea, eb = np.cumsum([len(x) for x in ba]), np.cumsum([len(x) for x in bb])
        sa, sb = ea - [len(x) for x in ba], eb - [len(x) for x in bb]
        found, groups = [], []
        for k in range(len(ia)):
            for j in range(len(ib)):
                if sa[k] < eb[j] and sb[j] < ea[k]:
                    found.append((ia[k], ib[j]))
        low = 0
        for end in sorted(set(ea.tolist()) & set(eb.tolist())):
            one = [str(i) for i, e in zip(ia, ea, strict=True) if low < e <= end]
            two = [str(i) for i, e in zip(ib, eb, strict=True) if low < e <= end]
            groups.append(",".join(one) + "|" + ",".join(two))
            low = end
        out.append([len(ia), len(ib), len(groups), len(found), ";".join(groups)])
        links.append(found)
    holders = Counter(p for found in links for p in set(found))
    most = defaultdict(int)
    for (a, _), n in holders.items():
        most[a] = max(most[a], n)
    return [(*o[:4], sum(holders[p] == most[p[0]] for p in f), sum(holders[p] for p in f), o[4]) for o, f in zip(out, links, strict=True)]


ODD = [None, "", " ", "  ", "a  b", " lead", "trail ", "x\ny\r\n z", "▁ under", "a<|endoftext|>b <s> </s> <unk>", "İstanbul ß é́ 中文 \U0001f600", "1234567890 3.14", "don't we'll", "a\x01b \x00", "a  b", "A. b, C.d"]


def test_alignment_equals_plain(spark, monkeypatch):
    draw = random.Random(2)
    words = "the quick stone's river naïve Straße letter 1999 don't maison's".split()
    texts = [*ODD, *(" ".join(draw.choice(words) for _ in range(draw.randrange(1, 60))) for _ in range(40))]
    texts += [texts[-1], texts[-1], "the river " * 90]
    want = plain_alignment(texts)
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, block string, codes string").repartition(5)
    found = alignment.align(docs, A_PATH, B_PATH, with_groups=True).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in found] == want
    hashed = alignment.align(docs, A_PATH, B_PATH).orderBy("doc_id").collect()
    assert [r.groups_sha256 for r in hashed] == [hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "" for w in want]
    assert [r.n_best for r in hashed] == [w[4] for w in want]


def test_alignment_of_empty_tables_null_ids_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, A_PATH, B_PATH).collect() == []
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (4, None), (4, "")], "doc_id int, text string")
    rows = sorted(alignment.align(docs, A_PATH, B_PATH).collect(), key=str)
    assert [(r.doc_id, r.n_links, r.count_sum) for r in rows] == [(4, 0, 0), (4, 0, 0), (None, 2, 4), (None, 2, 4)]


def test_long_texts_in_parts_and_small_blocks_change_nothing():
    a, b, names = alignment._loaded(A_PATH, B_PATH)
    draw = random.Random(5)
    text = " ".join(draw.choice(["river", "stone.", "été", "a", "naïve\nthe", "42"]) for _ in range(4000))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["the river", text, ""])], names=["doc_id", "text"])

    class Task:
        @staticmethod
        def partitionId():
            return 3

    def rows(block, part):
        alignment.BLOCK, alignment.PART = block, part
        out = []
        for x in alignment._aligner(A_PATH, B_PATH, True)(iter([batch])):
            out += [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")) for r in x.to_pylist() if r["codes"] is None]
        return out

    before, context = (alignment.BLOCK, alignment.PART), alignment.TaskContext
    alignment.TaskContext = type("C", (), {"get": staticmethod(lambda: Task)})
    try:
        small = rows(100, 500)
        assert len(alignment._parts(text)) > 5
        assert small == rows(1 << 30, 1 << 30)
    finally:
        (alignment.BLOCK, alignment.PART), alignment.TaskContext = before, context


def test_encoders_equal_whole_encoding():
    a, b, _ = alignment._loaded(A_PATH, B_PATH)
    one, two = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    one.encode_special_tokens = True

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(st.sampled_from("aéÉ İßx.,'sS!  \n\t▁\x01\x1c中́9<|endoftext|></s>")), min_size=1, max_size=6))
    def check(texts):
        for side, plain in ((a, lambda t: one.encode(t, add_special_tokens=False).ids), (b, two.encode)):
            ids, counts = side.encode(pa.array(texts, pa.string()))
            want = [plain(t) for t in texts]
            assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]

    check()


def plain_fim(doc_id, text, rate=90, spm_rate=20):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    x, y = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text, text
    spm = h[3] % 100 < spm_rate
    return doc_id, len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text


def test_fill_in_middle_equals_plain(spark, docs, rows, empty):
    extra = [(k, t) for k, t in enumerate([*ODD, "a<P>b", "<S>", "x<M>", "<P", "<", "P>q<S", "<<S<M", "\U0001f600" * 9, "é" * 50, "ab1" * 300])]
    for frame, given_rows in ((docs, [(r[0], r[1]) for r in rows]), (spark.createDataFrame(extra, "doc_id long, text string"), extra)):
        made = fill_in_middle.fill_in_middle(frame)
        found = made.select("*", fill_in_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
        assert sorted((tuple(r) for r in found), key=repr) == sorted((plain_fim(*r) for r in given_rows), key=repr)
    assert fill_in_middle.fill_in_middle(empty).collect() == []


def test_every_cut_between_units_is_restored(spark):
    texts = ["<S<P", "a<", "<P<", "S>M>P>", "<<<", ">a<S"]
    rows = [(k, texts[k % len(texts)]) for k in range(600)]
    made = fill_in_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), rate=100, spm_rate=50)
    found = made.select("doc_id", "output", "form", fill_in_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r.back == texts[r.doc_id % len(texts)] for r in found) and {r.form for r in found} == {"psm", "spm"}


def test_wavelet_ranks_equal_counts():
    draw = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = draw.integers(0, 7, size).astype(np.uint8)
        matrix = fill_in_middle.WaveletMatrix(symbols)
        at = np.arange(size + 1)
        for s in range(8):
            assert matrix.rank(s, at).tolist() == [int((symbols[:k] == s).sum()) for k in at]


def plain_copies(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[t or ""].append((i is not None, i or 0, k))
    out = []
    for text, members in groups.items():
        top = max(m[:2] for m in members)
        for known, i, _ in members:
            out.append((i if known else None, top[1] if top[0] else None, len(members), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("share", [0.0001, 0.05, 2.0])
def test_exact_duplicates_equal_plain(spark, monkeypatch, share):
    monkeypatch.setattr(exact_dedup, "HEAVY_SHARE", share)
    draw = random.Random(4)
    rows = [(draw.randrange(400) if draw.random() > 0.05 else None, draw.choice(["hot", "hot", "warm", "", None, "é", "é", f"own {draw.random()}", f"few {draw.randrange(40)}"])) for _ in range(900)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id int, text string, digest string, stays int").repartition(7)
    found = exact_dedup.exact_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == plain_copies(rows)
    kept = [r for r in found if r.kept]
    assert Counter(r.text_sha256 for r in kept) == Counter({r.text_sha256: 1 for r in found}) and all(r.doc_id == r.keep_id for r in kept)
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in left.collect()) == Counter((w[1], t) for w, t in {(w, t) for t in {t or "" for _, t in rows} for w in plain_copies(rows) if w[3] == hashlib.sha256(t.encode()).hexdigest() and w[0] == w[1]})


def test_heavy_digests_are_found_and_bounded(spark):
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 200 == 1, "warm").otherwise(F.col("id").cast("string")).alias("text"))
    table = exact_dedup.digests(rows, "id")
    found = {r.group_size for r in exact_dedup.heavy(table).collect()}
    assert {20_000} <= found and all(n >= 60 for n in found) and len(found) == 2
    assert exact_dedup.candidates(table).count() <= exact_dedup.CANDIDATES
    wide = spark.newSession()
    wide.conf.set("spark.sql.shuffle.partitions", "90")
    wide.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    many = exact_dedup.digests(wide.createDataFrame([(k, "same") for k in range(300)], "doc_id long, text string").repartition(40))
    assert [r.group_size for r in exact_dedup.heavy(many).collect()] == [300]
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
