"""Near-duplicate join on word shingles: a MinHash LSH forest finds candidates,
and they are verified exactly.

A document has a label in each tree, the MinHash values of one run of hash
functions.  Spark sorts the labels of every tree, so that a node of its trie,
all labels with one prefix, is a run of rows, and neighbours' longest common
prefixes give the sizes of all nodes a document lies in.  Each document then
chooses how much of its label must match in which tree.  It starts from whole
labels and shortens the prefix that brings in the fewest others, until another
document at just the threshold would be met with the target probability:
prefixes stay long in crowded parts of a trie and are short where nobody else
is.  Two documents are candidates if in some tree they share the prefix that
either of them chose.

Candidates whose sketches of all hash functions differ too much for the
threshold are dropped, the others are linked to clusters.  Clusters are cut
into blocks that are bounded in documents and in shingles, and the pairs of
two blocks are verified in one task by products of their incidence matrices.
Classes are the components of verified links.  No list of pairs is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

SPACE = r"[\x20\x09-\x0D]+"
TREES = 32
#: Values of a whole label, and bytes of each.
DEPTH = 8
_WIDTH = 2
TARGET_RECALL = 0.9999
#: How much shorter than all prefixes of one length a prefix may become.
_SHORTER = 2
#: Bytes of a sketch: two bits of each hash function's value.
_SKETCH = TREES * DEPTH // 4
#: A sketch agrees by chance this many standard deviations below the threshold.
_DEVIATIONS = 6
#: Members of a node that are compared with each other; larger nodes are candidates as a whole.
NODE_DOCS = 64
#: Rows of a part of a trie that a task holds at a time.
_HELD_ROWS = 1 << 19
#: Documents and shingles of a block; a task verifies two blocks at a time.
BLOCK_DOCS = 256
BLOCK_SHINGLES = 1 << 20
_COLUMNS = 4096

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def depth_for(threshold: float, trees: int = TREES, longest: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix that, if all trees had to match as much, would meet a
    document of just this similarity with at least the target probability."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words in order; null has none."""
    return F.transform(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), SPACE), ""), lambda w: F.xxhash64(w))


def _shingles(lists: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The distinct n-word shingles of each list of word hashes, sorted.  Fewer
    words than n are one shingle; none have no shingle."""
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
    words = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    size = len(words)
    h = np.zeros(max(size - n + 1, 0), np.uint64)
    for k in range(n):
        h = (h ^ words[k : k + len(h)]) * _C1
        h ^= h >> np.uint64(29)
    start = 0
    for end in ends.tolist():
        if end - start >= n:
            own = np.sort(h[start : end - n + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif end > start:
            one = np.zeros(1, np.uint64)
            for k in range(start, end):
                one = (one ^ words[k : k + 1]) * _C2
                one ^= one >> np.uint64(31)
            yield one
        else:
            yield np.zeros(0, np.uint64)
        start = end


def _signatures(n: int, trees: int):
    depth = DEPTH

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(20240229)
        a = draw.integers(0, 1 << 31, trees * depth, np.uint32) * np.uint32(2) + np.uint32(1)
        b = draw.integers(0, 1 << 32, trees * depth, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                k1, k2, sizes, labels, sketches = [], [], [], [], []
                for own in _shingles(part["words"], n):
                    key = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                    least = np.full(trees * depth, 0xFFFFFFFF, np.uint32)
                    low = (own >> np.uint64(32)).astype(np.uint32)
                    for k in range(0, len(low), 512):
                        np.minimum(least, (low[k : k + 512, None] * a + b).min(0), out=least)
                    k1.append(int(key[0]))
                    k2.append(int(key[1]))
                    sizes.append(len(own))
                    labels.append((least >> np.uint32(16)).astype("<u2").tobytes())
                    two = ((least >> np.uint32(14)) & np.uint32(3)).astype(np.uint8).reshape(-1, 4)
                    sketches.append((two << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["version"], pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sizes, pa.int32()), pa.array(labels, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "version", "k1", "k2", "n_shingles", "labels", "sketch"])

    return rows


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) bytes of a binary column whose values are all as long."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


def _matched(tree: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Values of the longest common prefix of each row and the next."""
    same = (label[1:] == label[:-1]).reshape(len(label) - 1, DEPTH, _WIDTH).all(2) & (tree[1:] == tree[:-1])[:, None]
    return np.cumprod(same, 1).sum(1)


def _parts(batches: Iterator[pa.RecordBatch], read, least: int):
    """Rows sorted by (tree, label) in parts that cut no node of ``least``
    values, unless it is larger than a task should hold: (columns, whether the
    part begins so, whether it ends so).  The partition's own ends count."""
    held, opened = None, True
    for batch in batches:
        if batch.num_rows == 0:
            continue
        now = read(batch)
        held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
        change = np.flatnonzero(_matched(held[0], held[1]) < least)
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield tuple(x[:cut] for x in held), opened, False
            held, opened = tuple(x[cut:] for x in held), False
        if len(held[0]) > _HELD_ROWS:
            yield held, opened, True
            held, opened = None, True
    if held is not None:
        yield held, opened, True


def _node_sizes(least: int):
    """(rep, tree, label, sizes) of rows that are not alone: members, 255 at
    most, of the nodes of least..DEPTH values.  Rows of a node that may go on
    elsewhere are never alone."""

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        return batch["tree"].to_numpy(), _fixed(batch["label"], DEPTH * _WIDTH), batch["rep"].to_numpy()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, label, rep), opens, ends in _parts(batches, read, least):
            matched = _matched(tree, label)
            node = [np.concatenate([[0], np.cumsum(matched < q)]) for q in range(least, DEPTH + 1)]
            sizes = np.stack([np.minimum(np.bincount(k)[k], 255) for k in node], 1).astype(np.uint8)
            ok = sizes[:, 0] > 1
            ok |= (opens & (node[0] == 0)) | (ends & (node[0] == node[0][-1]))
            yield pa.RecordBatch.from_arrays([pa.array(rep[ok]), pa.array(tree[ok]), pa.array([x.tobytes() for x in label[ok]], pa.binary()), pa.array([x.tobytes() for x in sizes[ok]], pa.binary())], names=["rep", "tree", "label", "sizes"])

    return rows


def chosen_depths(sizes: np.ndarray, threshold: float, target: float, least: int) -> np.ndarray:
    """Values that must match in each tree, of (documents, trees, least..DEPTH)
    sizes of nodes.  From whole labels on, the prefix is shortened that brings
    in the fewest others for what it adds, the first of equals, until a pair at
    the threshold meets with the target probability: 1 - prod(1 - threshold^d)."""
    docs, trees, _ = sizes.shape
    missed = -np.log1p(-(threshold ** np.arange(least, DEPTH + 1.0)))
    wanted = min(-np.log1p(-target), trees * missed[0] - 1e-9)
    depth = np.full((docs, trees), DEPTH - least)
    have = np.full(docs, trees * missed[-1])
    more = np.diff(-sizes.astype(np.int64), axis=2) / (missed[:-1] - missed[1:])  # [k]: from k + 1 to k
    open_ = np.flatnonzero(have < wanted)
    while len(open_):
        now = depth[open_]
        cost = np.where(now > 0, np.take_along_axis(more[open_], np.maximum(now - 1, 0)[..., None], 2)[..., 0], np.inf)
        tree = cost.argmin(1)
        at = now[np.arange(len(open_)), tree]
        depth[open_, tree] = at - 1
        have[open_] += missed[at - 1] - missed[at]
        open_ = open_[have[open_] < wanted]
    return depth + least


def _choices(trees: int, threshold: float, target: float, least: int):
    """(tree, label, depth, rep, sketch) of documents with their nodes' sizes."""
    width = DEPTH - least + 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                nodes = part["nodes"].flatten()
                doc = np.repeat(np.arange(part.num_rows), pc.list_value_length(part["nodes"]).to_numpy())
                tree = nodes.field("tree").to_numpy()
                sizes = np.ones((part.num_rows, trees, width), np.uint8)
                sizes[doc, tree] = _fixed(nodes.field("sizes"), width)
                depth = chosen_depths(sizes, threshold, target, least)[doc, tree]
                of = pa.array(doc)
                yield pa.RecordBatch.from_arrays([nodes.field("tree"), nodes.field("label"), pa.array(depth.astype(np.int32)), part["rep"].take(of), part["sketch"].take(of)], names=["tree", "label", "depth", "rep", "sketch"])

    return rows


def _agree(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Do sketches agree as much as those of documents at the threshold?"""
    n, p = 4 * _SKETCH, threshold + (1 - threshold) / 4
    least = n * p - _DEVIATIONS * np.sqrt(n * p * (1 - p))
    x = a ^ b
    apart = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(1)
    return n - apart >= least


def _candidates(threshold: float, least: int):
    """Rows (a, b) that link candidates below one node, and rows (part, last,
    tree, label, rep) of each end of a part, where a node may go on."""
    names = ["a", "b", "part", "last", "tree", "label"]

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        return batch["tree"].to_numpy(), _fixed(batch["label"], DEPTH * _WIDTH), batch["rep"].to_numpy(), batch["depth"].to_numpy(), np.ascontiguousarray(_fixed(batch["sketch"], _SKETCH)).view(np.uint64)

    def links(rep: np.ndarray, sketch: np.ndarray, group: np.ndarray) -> Iterator[np.ndarray]:
        """A spanning forest of each group's members whose sketches agree."""
        size = np.bincount(group)
        first = np.cumsum(size) - size
        large = np.flatnonzero(size[group] > NODE_DOCS)
        yield np.stack([rep[first[group[large]]], rep[large]], 1)
        own = np.flatnonzero((size[group] > 1) & (size[group] <= NODE_DOCS))
        root = np.arange(len(rep))

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for apart in range(1, NODE_DOCS):
            own = own[(own + apart < len(rep))]
            own = own[group[own + apart] == group[own]]
            if len(own) == 0:
                break
            ahead = own + apart
            new = own[root[root[own]] != root[root[ahead]]]
            new = new[_agree(sketch[new], sketch[new + apart], threshold)]
            found = []
            for k in new.tolist():
                x, y = top(k), top(k + apart)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    found.append(k)
            found = np.array(found, np.int64)
            yield np.stack([rep[found], rep[found + apart]], 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for (tree, label, rep, depth, sketch), opens, ends in _parts(batches, read, least):
            matched = _matched(tree, label)
            below = np.zeros(len(matched), bool)
            for q in range(least, DEPTH + 1):
                node = np.concatenate([[0], np.cumsum(matched < q)])
                active = np.bincount(node, depth == q) > 0
                if q == least:  # a node that goes on elsewhere may be active there
                    active[0] |= opens
                    active[-1] |= ends
                below |= (matched >= q) & active[node[:-1]]
            pairs = np.concatenate(list(links(rep, sketch, np.concatenate([[0], np.cumsum(~below)]))))
            none = pa.nulls(len(pairs))
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1)), none.cast(pa.int64()), none.cast(pa.bool_()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
            for k, last in [(0, False)] * opens + [(-1, True)] * ends:
                yield pa.RecordBatch.from_arrays([pa.array([rep[k]]), pa.array([rep[k]]), pa.array([part * (1 << 32) + place]), pa.array([last]), pa.array([tree[k]], pa.int32()), pa.array([label[k].tobytes()], pa.binary())], names=names)
            place += 1

    return rows


def candidate_links(reps: DataFrame, threshold: float, trees: int, target: float) -> DataFrame:
    """Distinct (a, b), a < b, that connect all candidates of each other."""
    least = max(1, depth_for(threshold, trees, DEPTH, target) - _SHORTER)
    width = DEPTH * _WIDTH
    label = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.substring("labels", t * width + 1, F.lit(width)).alias("label")))
    order = ["tree", "label", "rep"]
    sorted_ = reps.select("rep", F.inline(label)).repartitionByRange(*order).sortWithinPartitions(*order)
    nodes = sorted_.mapInArrow(_node_sizes(least), "rep long, tree int, label binary, sizes binary")
    nodes = nodes.groupBy("rep").agg(F.collect_list(F.struct("tree", "label", "sizes")).alias("nodes"))  # a row for each tree at most
    chosen = nodes.join(reps.select("rep", "sketch"), "rep").mapInArrow(_choices(trees, threshold, target, least), "tree int, label binary, depth int, rep long, sketch binary")
    chosen = common.written(chosen, "near-labels")
    found = chosen.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_candidates(threshold, least), "a long, b long, part long, last boolean, tree int, label binary")
    found = common.written(found, "near-candidates")
    # Ends of parts, a few for each task: a node that goes on from one to the next is linked over the cut.
    ends = found.where("part is not null")
    before = Window.orderBy("part", "last")
    prefix = F.struct("tree", F.substring("label", 1, least * _WIDTH))
    met = ends.select("b", F.lag("a").over(before).alias("a"), (F.lag(prefix).over(before) == prefix).alias("same"), "last").where("same and not last")
    return found.where("part is null").select("a", "b").unionByName(met.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _verify(threshold: float):
    """Rows of one key (cluster, i, j) at a time, sorted by key: two blocks of
    bounded size.  Emits for each linked document (a, b, n): b is the least
    document it reaches here and n the copies of those it is linked with."""

    def pairs(rows: list[tuple]) -> list[tuple]:
        rows = list({r[0]: r for r in rows}.values())
        ids = np.array([r[0] for r in rows], np.int64)
        copies = np.array([r[1] for r in rows], np.int64)
        block = np.array([r[2] for r in rows])
        sets = [r[3] for r in rows]
        sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(rows)), sizes)
        often = count[code] > 1
        column = (np.cumsum(count > 1) - 1)[code[often]]
        owner = owner[often]
        inter = np.zeros((len(rows), len(rows)), np.float64)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for k in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
            a, b = np.searchsorted(column, [k, k + _COLUMNS])
            m = np.zeros((len(rows), _COLUMNS), np.float32)
            m[owner[a:b], column[a:b] - k] = 1
            inter += m @ m.T
        union = sizes[:, None] + sizes[None, :] - inter
        linked = inter >= threshold * union - 1e-6
        np.fill_diagonal(linked, False)
        if block.min() != block.max():
            linked &= block[:, None] != block[None, :]
        label = ids.copy()
        while True:
            new = np.minimum(label, np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1))
            if (new == label).all():
                break
            label = new
        n = linked @ copies
        return [(int(i), int(r), int(c)) for i, r, c in zip(ids, label, n, strict=True) if c]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["a", "b", "n"])

        for batch in stream:
            keys = list(zip(*(batch[c].to_pylist() for c in ("cluster", "i", "j")), strict=True))
            ids, copies, block = (batch[c].to_pylist() for c in ("rep", "copies", "block"))
            found = []
            for r in range(batch.num_rows):
                if keys[r] != key:
                    if len(held) > 1:
                        found += pairs(held)
                    key, held = keys[r], []
                held.append((ids[r], copies[r], block[r], batch["shingles"][r].values.to_numpy().view(np.uint64)))
            if found:
                yield out(found)
        if len(held) > 1:
            yield out(pairs(held))

    return batches


def _sets(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [s.view(np.int64) for s in _shingles(batch["words"], n)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in own])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch["rep"], batch["cluster"], batch["copies"], batch["blocks"], lists], names=["rep", "cluster", "copies", "blocks", "shingles"])

    return rows


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5, threshold: float = 0.8, trees: int = TREES, target_recall: float = TARGET_RECALL) -> DataFrame:
    """A row per document: doc_id, class_id, n_links.

    Two documents are linked if the Jaccard similarity of their sets of n-word
    shingles is at least ``threshold``; ``class_id`` is the least id of a
    document's connected component and ``n_links`` the number of documents it
    is linked with, copies included.  Links are verified exactly; a pair at
    the threshold becomes a candidate with probability ``target_recall`` at
    least (or with what the shortest prefixes give), a closer one with more.

    Words are runs of anything but ASCII white space.  Fewer than n words are
    one shingle; a text without words, or null, is linked with nothing.  Rows
    that share an id are one document and get one row: the text with the least
    hash stands for it.  A row without an id gets a null class and no links.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("version", F.xxhash64("text"))
    schema = "doc_id long, version long, k1 long, k2 long, n_shingles int, labels binary, sketch binary"
    signed = own.where("doc_id is not null").select("doc_id", "version", word_hashes(F.col("text")).alias("words")).mapInArrow(_signatures(n, trees), schema)
    one = signed.groupBy("doc_id").agg(F.min(F.struct("version", "k1", "k2", "n_shingles", "labels", "sketch")).alias("s"))
    signed = common.written(one.select("doc_id", "s.*"), "near-signatures")

    # Documents with equal shingle sets are one class from the start: its least id stands for it.
    sets = signed.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    sets = common.written(sets, "near-copies")  # a table by itself, so that a join with a hot set can be split
    stands = (F.col("doc_id") == F.coalesce("rep", "doc_id")) & (F.col("n_shingles") > 0)
    members = signed.join(sets, ["k1", "k2"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"), "version", "n_shingles", F.when(stands, F.col("labels")).alias("labels"), F.when(stands, F.col("sketch")).alias("sketch"))
    members = common.written(members, "near-members")
    reps = members.where("labels is not null")

    clusters = components(candidate_links(reps, threshold, trees, target_recall)).select(F.col("node").alias("rep"), F.col("label").alias("cluster"))
    sized = clusters.join(reps.select("rep", "copies", "version", "n_shingles"), "rep")
    blocks = sized.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    active = sized.join(blocks, "cluster")
    texts = own.join(active.withColumnRenamed("rep", "doc_id"), ["doc_id", "version"]).withColumnRenamed("doc_id", "rep").select("rep", "cluster", "copies", "blocks", word_hashes(F.col("text")).alias("words"))
    shingled = common.written(texts.mapInArrow(_sets(n), "rep long, cluster long, copies long, blocks int, shingles array<long>"), "near-sets")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = shingled.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "copies", "block", "shingles")
    # By ranges, so that the pairs of blocks of a large cluster are dealt evenly.
    pairs = dealt.repartitionByRange("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    links = common.written(pairs.mapInArrow(_verify(threshold), "a long, b long, n long"), "near-links")

    degrees = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    classes = components(links.where("a <> b").select("a", "b")).select(F.col("node").alias("rep"), "label")
    result = members.select("doc_id", "rep", "copies").join(degrees, "rep", "left").join(classes, "rep", "left")
    result = result.select("doc_id", F.coalesce("label", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"))
    none = own.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return result.unionByName(none)
