"""Top-k, near duplicates, substring removal, mixing and the pipeline against
brute force."""

import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafwork.llm import components, mixing, near_dup, substring_dedup, topk


def test_top_k_matches_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(3)
    vectors = [(k, [float(np.float32(v)) for v in draw.normal(size=4).round(1)]) for k in range(330)]
    vectors += [(400 + k, vectors[5][1]) for k in range(60)]  # ties
    vectors += [(500, None), (600, [1.0, None, 0.0, 0.0]), (700, [float("nan"), 0.0, 0.0, 0.0]), (800, [float("inf")] * 4), (900, []), (901, []), (1000, [0.5, 0.5]), (1100, [1e300, -1e300]), (1101, [1e300, 3e15]), (1102, [2.5e12, 0.125]), (vectors[7][0], vectors[7][1])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("vector", F.lit(1))
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(topk, "BINS", 8)
    got = sorted(tuple(r) for r in topk.exact_top_k(frame, frame.where("vec_id % 100 = 0"), 10).collect())
    fine = [(i, [int(np.floor(x * 1024)) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q, v in {i: v for i, v in fine if i % 100 == 0}.items():
        scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in fine if i != q and len(w) == len(v))[:10]
        expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(expected)
    assert topk.exact_top_k(frame.limit(0), frame.limit(0)).count() == 0


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()


def classes(sets):
    """(class, links) of each key by comparing all pairs."""
    links, parent = defaultdict(int), {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 5 * len(x & y) >= 4 * len(x | y):
            links[a] += 1
            links[b] += 1
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return {k: (root(k), links[k]) for k in sets}


def test_near_duplicates_match_all_pairs(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 3)
    got = [tuple(r) for r in near_dup.near_duplicates(docs).collect()]
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None and i != 74}
    expected = {k: v for k, v in classes(sets).items()}
    assert {g[0]: g[1:] for g in got if g[0] is not None and g[0] != 74} == expected
    assert len([g for g in got if g[0] is not None]) == len(sets) + 1
    assert [g[1:] for g in got if g[0] is None] == [(None, 0)]
    assert near_dup.near_duplicates(empty).count() == 0


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Blocks of a group meet pairwise; chains of links are one class."""
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 4)
    words = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(40):
        own = list(words)
        own[3 * k % 120] = f"edit{k}"
        own[(7 * k + 50) % 120] = f"more{k}"
        texts.append((k, " ".join(own)))
    texts += [(100 + k, texts[0][1]) for k in range(30)]
    got = {r["doc_id"]: tuple(r)[1:] for r in near_dup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == classes({i: shingles(t) for i, t in texts})


def test_prefixes_are_shortened_to_the_target():
    least = near_dup.depth_for(0.8) - 2
    draw = np.random.default_rng(1)
    sizes = np.sort(draw.integers(1, 200, (50, near_dup.TREES, near_dup.DEPTH - least + 1)).astype(np.uint8), 2)[:, :, ::-1]
    sizes[0] = 1  # nobody else anywhere
    sizes[1, :20] = 1  # crowded in twelve trees only
    depth = near_dup.chosen_depths(sizes, 0.8, near_dup.TARGET_RECALL, least)
    recall = 1 - np.prod(1 - 0.8**depth.astype(float), 1)
    assert (recall >= near_dup.TARGET_RECALL).all() and (recall < 1 - (1 - near_dup.TARGET_RECALL) / 2).all()
    assert (depth[1, 20:] == near_dup.DEPTH).all() and depth.min() == least


def test_recall_of_candidates_at_the_threshold(spark, monkeypatch):
    """Pairs at just over 0.8 among texts that share a boilerplate, over many
    partitions, nodes compared whole and in part: every link is found."""
    monkeypatch.setattr(near_dup, "NODE_DOCS", 6)
    monkeypatch.setattr(near_dup, "_HELD_ROWS", 40)
    draw = np.random.default_rng(9)
    word = lambda: f"w{draw.integers(0, 10**9)}"
    shared, texts = [word() for _ in range(60)], []
    for k in range(60):
        own = [word() for _ in range(55)]
        near = list(own)
        near[20] = word()
        near[47] = word()
        tail = shared[: 30 * (k % 3)]
        texts += [(3 * k, " ".join(own + tail)), (3 * k + 1, " ".join(near + tail)), (3 * k + 2, " ".join([*own[:30], *(word() for _ in range(25)), *tail]))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r["doc_id"]: tuple(r)[1:] for r in near_dup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = classes({i: shingles(t) for i, t in texts})
    linked = [i for i in want if want[i][1]]
    assert len(linked) == 40
    assert sum(got[i] == want[i] for i in linked) / len(linked) == 1 and got == want


@pytest.mark.parametrize(("n", "m", "chain"), [(60, 45, 0), (200, 190, 60), (10, 0, 0)])
def test_components(spark, n, m, chain):
    draw = np.random.default_rng(n)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, n, (m, 2))] + [(500 + k, 501 + k) for k in range(chain)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: root(k) for k in parent}


def removed(rows):
    """Marked bytes of each row by looking up every 50-byte string."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if i is not None:
                first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    for i, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                mark[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, m in zip(b, mark, strict=True) if not m)
        spans = sum(1 for k in range(len(b)) if mark[k] and not (k and mark[k - 1]))
        yield i, len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest()


def test_substring_removal_matches_brute_force(spark, docs, rows, empty):
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(docs).collect()), key=repr)
    assert got == sorted(removed([r[:2] for r in rows]), key=repr)
    assert sum(g[2] for g in got) > 1000
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_removal_of_patterned_texts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 700)
    draw = np.random.default_rng(4)
    parts = ["".join(draw.choice(list("ab é"), 60)) for _ in range(12)] + ["a" * 120, "ab" * 70]
    texts = [(k, "".join(draw.choice(parts, draw.integers(0, 9))) + "".join(draw.choice(list("xyz"), draw.integers(0, 40)))) for k in range(40)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in substring_dedup.remove_repeats(frame).collect())
    assert got == sorted(removed(texts))
    kept = {r["doc_id"]: bytes(r["kept"]) for r in substring_dedup.remove_repeats(frame, with_text=True).collect()}
    assert all(hashlib.sha256(kept[g[0]]).hexdigest() == g[4] for g in got)


def divided(share, weights, caps):
    """Whole shares by weight, one full child after the other."""
    out, left, active = [0] * len(caps), share, [k for k, w in enumerate(weights) if w > 0 and caps[k] > 0]
    while active:
        total = sum(weights[k] for k in active)
        full = [k for k in active if caps[k] * total <= left * weights[k]]
        if not full:
            exact = {k: left * weights[k] / total for k in active}
            for k in active:
                out[k] = int(exact[k])
            over = left - sum(out[k] for k in active)
            for k in sorted(active, key=lambda k: (out[k] - exact[k], k))[:over]:
                out[k] += 1
            return out
        for k in full:
            out[k] = caps[k]
            left -= caps[k]
        active = [k for k in active if k not in full]
    return out


def allocation(budget, caps, weights):
    order = lambda path: tuple("" if v is None else "=" + v for v in path)
    usable = {p: c if all(weights.get(p[:k], 1) > 0 for k in range(1, len(p) + 1)) else 0 for p, c in caps.items()}

    def spread(share, prefix):
        if prefix in caps:
            return {prefix: share}
        names = sorted({p[: len(prefix) + 1] for p in caps if p[: len(prefix)] == prefix}, key=order)
        own = divided(share, [weights.get(n, 1) for n in names], [sum(c for p, c in usable.items() if p[: len(n)] == n) for n in names])
        return {p: t for n, s in zip(names, own, strict=True) for p, t in spread(s, n).items()}

    return spread(budget, ()) if caps else {}


def allocated(spark, budget, caps, weights):
    rows = [(*("" if v is None else "=" + v for v in p), c) for p, c in caps.items()]
    names = [f"l{k}" for k in range(len(next(iter(caps))))]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names) + ", cap long")
    return {tuple(None if r[n] == "" else r[n][1:] for n in names): r["target"] for r in mixing.allocate(frame, names, budget, weights).collect()}


def test_allocation_prefers_siblings(spark):
    caps = {("a", "x"): 10, ("a", "y"): 100, ("b", "x"): 100}
    assert allocation(100, caps, {}) == {("a", "x"): 10, ("a", "y"): 40, ("b", "x"): 50}
    assert allocated(spark, 180, caps, {}) == {("a", "x"): 10, ("a", "y"): 80, ("b", "x"): 90}
    assert allocated(spark, 100, caps, {("a",): 3.0}) == {("a", "x"): 10, ("a", "y"): 65, ("b", "x"): 25}


def test_a_weight_of_zero_loses_no_budget(spark):
    caps = {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 100}
    assert allocated(spark, 100, caps, {("a", "y"): 0}) == {("a", "x"): 10, ("a", "y"): 0, ("b", "z"): 90}
    assert allocation(100, caps, {("b",): 0}) == {("a", "x"): 10, ("a", "y"): 90, ("b", "z"): 0}


@pytest.mark.parametrize("seed", [1])
def test_allocation_matches_plain_division(spark, seed):
    draw = np.random.default_rng(seed)
    names = [None, "", "a", "b", "c"]
    caps = {(x, y, z): int(draw.integers(0, 200)) for x in names for y in names for z in names if draw.random() < 0.5}
    weights = {p[:k]: float(draw.choice([0, 0.5, 1, 3])) for p in caps for k in (1, 2, 3) if draw.random() < 0.4}
    usable = sum(c for p, c in caps.items() if all(weights.get(p[:k], 1) > 0 for k in (1, 2, 3)))
    for budget in (usable // 3, usable - 1):
        got = allocated(spark, budget, caps, weights)
        assert got == allocation(budget, caps, weights)
        assert sum(got.values()) == min(budget, usable)


def test_mixing_over_very_many_leaves(spark):
    """No list of leaves is made, so there is no limit to them."""
    frame = spark.range(0, 120_000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.col("id").cast("string").alias("source"), F.lit(1).alias("_mix_epoch"), F.lit(2).alias("_mix_0"))
    mixed = mixing.mix(frame, {"half": F.col("doc_id") % 2, "source": F.col("source")}, budget_share=0.5)
    assert mixed.columns == ["doc_id", "text", "source", "_mix_0", "_mix_epoch"]
    assert mixed.where("_mix_epoch <> 0").isEmpty()
    assert mixed.count() == 0  # each leaf's share is a word, and no document is cut


@pytest.mark.parametrize(("share", "epochs", "cut"), [(0.5, 1, 256), (1.6, 3, 2)])
def test_mixing_takes_prefixes_of_seeded_epochs(docs, rows, empty, monkeypatch, share, epochs, cut):
    monkeypatch.setattr(mixing, "CUT_DOCS", cut)
    levels = {"language": F.col("lang"), "source": F.col("source")}
    weights = {("en",): 2.0}
    mixed = mixing.mix(docs, levels, budget_share=share, weights=weights, max_epochs=epochs, seed=5).collect()
    sizes = defaultdict(int)
    for _, t, lang, source, *_ in rows:
        sizes[lang, source] += len((t or "").split())
    target = allocation(int(share * sum(sizes.values())), {k: epochs * v for k, v in sizes.items()}, weights)
    order = {}
    hashes = docs.select("doc_id", "text", *(F.xxhash64(F.xxhash64("doc_id", "text"), F.lit(5), F.lit(e).cast("long")).alias(f"h{e}") for e in range(epochs + 1))).collect()
    for r in hashes:
        for e in range(epochs + 1):
            order[r["doc_id"], r["text"], e] = r[f"h{e}"] % (1 << 64)
    expected = []
    for leaf, n in sizes.items():
        own = [r for r in rows if (r[2], r[3]) == leaf]
        full = target[leaf] // n if n else epochs
        left = target[leaf] - full * n
        for e in range(full):
            expected += [(r[0], r[1], e) for r in own]
        groups = itertools.groupby(sorted(own, key=lambda r: order[r[0], r[1], full]), key=lambda r: order[r[0], r[1], full])
        total = 0
        for _, group in groups if left > 0 else []:
            group = list(group)
            total += sum(len((r[1] or "").split()) for r in group)
            if total > left:
                break
            expected += [(r[0], r[1], full) for r in group]
    assert sorted(((r["doc_id"], r["text"], r["_mix_epoch"]) for r in mixed), key=repr) == sorted(expected, key=repr)
    assert mixing.mix(empty, levels).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    base = str(tmp_path)
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(78, 0, 0), (76, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    now, before = spark.read.parquet(f"{base}/documents.parquet"), None
    for name, stage in pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, base).cache()
        assert now.columns == docs.columns, name
        if name == "n-gram Jaccard join":
            ids = [r["doc_id"] for r in now.collect() if r["doc_id"] is not None]
            assert len(ids) == len(set(ids))
            same = classes({r["doc_id"]: shingles(r["text"]) for r in before.collect() if r["doc_id"] is not None and r["doc_id"] != 74})
            assert {i for i in ids if i != 74} == {c for c, _ in same.values()}
        if name == "secret scans":
            assert now.count() == before.count()
            assert now.where("text like '%0123456789abcdef%'").isEmpty()
    pieces = pipeline.STAGES[-1][1](spark, now, base)
    assert pieces.where("start = 0").count() == now.count()
    assert pipeline.run(spark, base).count() == pieces.count()


def test_substring_removal_of_an_id_in_two_batches(spark):
    """A name that two documents of a batch share must meet the same id elsewhere."""
    p = "".join(chr(97 + (k * k + 7 * k) % 26) for k in range(400))
    here, there = [(5, "A" * 60 + p), (1, "B" * 60 + p)], [(5, "C" * 60 + p)]
    schema = "doc_id long, text string"
    frame = spark.createDataFrame(here, schema).coalesce(1).unionByName(spark.createDataFrame(there, schema).coalesce(1))
    got = sorted(tuple(r) for r in substring_dedup.remove_repeats(frame).collect())
    assert got == sorted(removed(here + there)) and [g[2] for g in got] == [0, 400, 400]


@pytest.mark.parametrize(("seed", "parts"), [(1, 3), (2, 9)])
def test_substring_removal_with_repeated_ids_over_partitions(spark, seed, parts):
    draw = np.random.default_rng(seed)
    shared = ["".join(draw.choice(list("abcdefgh"), 90)) for _ in range(8)]
    rows = [(int(draw.integers(0, 9)), "".join(draw.choice(list("uvwxyz"), draw.integers(0, 50))) + "".join(draw.choice(shared, draw.integers(0, 4)))) for _ in range(70)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert sorted(tuple(r) for r in substring_dedup.remove_repeats(frame).collect()) == sorted(removed(rows))


def test_substring_removal_of_texts_that_differ_in_a_byte(spark):
    """The byte may stand anywhere in a window: no name may leave it out."""
    draw = np.random.default_rng(5)
    base = "".join(draw.choice(list("abcdefghijklmnop "), 240))
    rows = [(0, base)] + [(k, base[: 60 + k] + "#" + base[61 + k :]) for k in range(1, 120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r) for r in substring_dedup.remove_repeats(frame).collect())
    assert got == sorted(removed(rows)) and {g[2] for g in got[1:]} == {239}


def test_substring_removal_of_texts_with_changes_that_make_up_for_each_other(spark):
    """Three bytes that changed both names of 16 bytes by sums that cancel."""
    draw = np.random.default_rng(6)
    base = "".join(draw.choice(list("abcdefghijklmnop "), 300))
    a, b = "hbc xgihmr ntxfl", "hbc xgitmr jtxfp"
    rows = [(50 * (t is b) + k, base[: 40 + k] + t + base[60 : 120 + k]) for k in range(20) for t in (a, b)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in substring_dedup.remove_repeats(frame).collect()) == sorted(removed(rows))


def test_substring_removal_sorts_narrow_rows_by_one_number(spark, monkeypatch):
    """CPU seconds: Spark sorts one long by radix, two columns by comparing; and
    where ids are unique no row carries a version."""
    plans = []
    kept = substring_dedup.common.written
    monkeypatch.setattr(substring_dedup.common, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, name))
    p = "".join(chr(97 + (k * k + 7 * k) % 26) for k in range(300))
    rows = [(k, str(k) * 60 + p) for k in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted(tuple(r) for r in substring_dedup.remove_repeats(frame).collect()) == sorted(removed(rows))
    sorts = [line for plan in plans for line in plan.splitlines() if " Sort [" in line or line.startswith("Sort [")]
    assert len(sorts) == 4 and all(line.count("ASC") == 1 for line in sorts)
    assert not any("version" in plan for plan in plans)


def test_substring_removal_sends_a_shared_name_once(spark):
    """Only a name with many rows in a batch is worth the two rows that stand for them."""
    draw = np.random.default_rng(8)
    p = "".join(draw.choice(list("abcdefghijklmnop "), 4000))
    texts = substring_dedup.pa.array([p, p])
    batch = substring_dedup.pa.RecordBatch.from_arrays([substring_dedup.pa.array([3, 4]), texts], names=["doc_id", "text"])
    own = len(substring_dedup.picked(substring_dedup.Texts(texts))[0])
    assert own > 300 and sum(b.num_rows for b in substring_dedup._suffixes(["doc_id"])([batch])) == own


@pytest.mark.parametrize("block", [37, 200, 1 << 16])
def test_each_window_picks_its_leftmost_least_name(monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    draw = np.random.default_rng(9)
    parts = ["".join(draw.choice(list("ab é"), draw.integers(0, 300))) for _ in range(15)] + ["x" * 130, "", "x" * 49, "x" * 50, "abc" * 40]
    texts = substring_dedup.Texts(substring_dedup.pa.array(parts))
    names = substring_dedup._name(texts.words[:-8], texts.words[8:])
    expected = {}
    for low, high in zip(texts.bounds[:-1], texts.bounds[1:], strict=True):
        for w in range(low, high - 49):
            at = w + int(np.argmin(names[w : w + 35] & ~substring_dedup._SPOT))
            expected[at] = (expected.get(at, (w,))[0], w)
    at, first, last, own = substring_dedup.picked(texts)
    assert dict(zip(at.tolist(), zip(first.tolist(), last.tolist(), strict=True), strict=True)) == expected
    assert len(at) == len(expected) and (own == names[at]).all()


def test_substring_removal_of_a_row_repeated_often(spark, monkeypatch):
    """Windows of a repeated row are listed once for its id, not once for each copy."""
    lists, kept = {}, substring_dedup.common.written
    monkeypatch.setattr(substring_dedup.common, "written", lambda df, name: lists.setdefault(name, kept(df, name)))
    draw = np.random.default_rng(10)
    p, q = ("".join(draw.choice(list("abcdefghijklmnop "), 200)) for _ in range(2))
    rows = [(7, p + q)] * 40 + [(8, q + p)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in substring_dedup.remove_repeats(frame).collect()) == sorted(removed(rows))
    most = [substring_dedup.F.max(substring_dedup.F.size(c)) for c in lists["suffix-open"].columns if c not in ("doc_id", "version")]
    assert lists["suffix-open"].agg(*most).first()[0] < 100
