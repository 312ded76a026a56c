"""Mixing sources to target weights: hierarchical token budgets and seeded
token prefixes of each leaf."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents of a leaf that may be sorted together to find where its prefix ends.
CUT_DOCS = 256
_DIGIT = 8

Path = tuple[str | None, ...]


def _value(level: Column) -> Column:
    """A level's value as a key that tells null from an empty text."""
    return F.coalesce(F.concat(F.lit("="), level.cast("string")), F.lit(""))


def _weights(nodes: DataFrame, own: Sequence[str], weights: Mapping[Path, float]) -> DataFrame:
    """``nodes`` with the weight of each one's path, 1 where none is given."""
    rows = [(*("" if v is None else f"={v}" for v in path), float(w)) for path, w in weights.items() if len(path) == len(own)]
    if not rows:
        return nodes.withColumn("weight", F.lit(1.0))
    given = nodes.sparkSession.createDataFrame(rows, ", ".join(f"{c} string" for c in own) + ", weight double")
    return nodes.join(given, list(own), "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def water_fill(children: DataFrame, parent: Sequence[str], path: Sequence[str]) -> DataFrame:
    """Whole shares of each parent's ``share`` for its children, in ``own``.

    A child gets by ``weight`` and ``cap`` at most; what it cannot take goes to
    its siblings by weight, until all are full or the share is spent.  In order
    of cap / weight the full ones come first: a child is full if all the
    share divided so that it is just full does not go beyond the share.  What
    whole numbers leave over goes, one each, to the largest fractions.
    Children without weight or cap get nothing.  A parent's children are
    sorted together: a row for each node of the tree, never one for a document.
    """
    usable = children.withColumns({"weight": F.greatest("weight", F.lit(0.0)), "cap": F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0).cast("long"))})
    usable = usable.withColumn("_at", F.when(F.col("cap") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(0.0)))
    whole = Window.partitionBy(*parent)
    order = whole.orderBy("_at", *path)
    to_here, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    usable = usable.withColumns({"_caps": F.sum("cap").over(to_here), "_rest": F.coalesce(F.sum(F.when(F.col("cap") > 0, F.col("weight"))).over(after), F.lit(0.0))})
    usable = usable.withColumn("_full", F.col("_caps") + F.col("_at") * F.col("_rest") <= F.col("share"))
    sums = {"_taken": F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(whole), F.lit(0)), "_open": F.sum(F.when(~F.col("_full"), F.col("weight")).otherwise(F.lit(0.0))).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}
    usable = usable.withColumns(sums)
    exact = F.when(F.col("_full"), F.col("cap").cast("double")).otherwise((F.col("share") - F.col("_taken")) * F.col("weight") / F.col("_open"))
    usable = usable.withColumn("_exact", exact).withColumn("own", F.least(F.floor("_exact"), F.col("cap")))
    most = Window.partitionBy(*parent).orderBy(F.desc(F.when(F.col("own") < F.col("cap"), F.col("_exact") - F.col("own")).otherwise(F.lit(-1.0))), *path)
    over = F.least(F.col("share"), F.sum("cap").over(whole)) - F.sum("own").over(whole)
    extra = F.when((F.col("own") < F.col("cap")) & (F.row_number().over(most) <= over), 1).otherwise(0)
    return usable.withColumn("own", F.col("own") + extra).drop("_at", "_caps", "_rest", "_full", "_taken", "_open", "_exact")


def allocate(leaves: DataFrame, names: Sequence[str], budget: int, weights: Mapping[Path, float]) -> DataFrame:
    """``leaves`` (the columns ``names``, as :func:`_value` has them, and
    ``cap``, what a leaf can give) with ``target``, its tokens.

    ``weights`` has a weight by path prefix, 1 by default; what lies below a
    weight of 0 takes no part.  A node's share goes to its children by weight;
    a child's shortage goes to its siblings, and leaves the node only when all
    of them are full: from the root down each level is divided by
    :func:`water_fill`.  Targets are whole and add up to the budget, or to all
    usable caps.  There is no limit to the number of leaves.
    """
    usable = F.lit(True)
    nodes = leaves
    for k in range(1, len(names) + 1):
        nodes = _weights(nodes, names[:k], weights)
        usable = F.col("_on") if k > 1 else F.lit(True)
        nodes = nodes.withColumn("_on", usable & (F.col("weight") > 0)).withColumnRenamed("weight", f"_weight{k}")
    nodes = nodes.withColumn("cap", F.when(F.col("_on"), F.col("cap")).otherwise(F.lit(0).cast("long")))
    shares = nodes.sparkSession.createDataFrame([(0, int(budget))], "_root int, share long")
    for k in range(1, len(names) + 1):
        above = ["_root", *names[: k - 1]]
        level = nodes.groupBy(*names[:k]).agg(F.sum("cap").alias("cap"), F.first(f"_weight{k}").alias("weight")).withColumn("_root", F.lit(0))
        divided = water_fill(level.join(shares, above), above, names[:k])
        shares = divided.select("_root", *names[:k], F.col("own").alias("share"))
    return leaves.join(shares.select(*names, F.col("share").alias("target")), list(names))


def words(text_col: str = "text") -> Column:
    """Words of a text, the default measure of its tokens; null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(F.col(text_col), r"\s+"), "")), F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    *,
    budget: int | None = None,
    budget_share: float = 1.0,
    weights: Mapping[Path, float] | None = None,
    max_epochs: int = 1,
    seed: int = 17,
    tokens: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Select documents so that each leaf's tokens meet its target.

    ``levels`` names the tree's levels from the root, e.g. domain, language,
    source; null is a value of its own, apart from an empty text.  The budget
    is in tokens, or ``budget_share`` of all tokens.  A leaf gives up to
    ``max_epochs`` times its tokens: whole epochs first, then the longest
    prefix of the next epoch's seeded order that stays within its target.  A
    document without tokens comes with its leaf's whole epochs.  Rows that are
    equal in id and text are taken or left together.

    Returns the rows of ``docs`` with ``_mix_epoch``, a row per epoch; a column
    of docs that has this name is replaced.  Nothing but totals is shuffled:
    each leaf's cut is found in its order key, digit by digit, from sums of at
    most 256 buckets a leaf, so a leaf that holds most rows is no more work for
    any task than another.  Totals, targets and cuts are tables with a row for
    each leaf; nothing of them reaches the driver, and Spark broadcasts them
    only if they are small.
    """
    weights = weights or {}
    leaf_cols = [f"_mix_{k}" for k in range(len(levels))]
    leaf = [_value(c).alias(name) for c, name in zip(levels.values(), leaf_cols, strict=True)]
    own_hash = F.xxhash64(F.col(id_col), F.col(text_col)).alias("_mix_hash")
    size = F.coalesce((words(text_col) if tokens is None else tokens).cast("long"), F.lit(0).cast("long"))
    slim = common.written(docs.select(*leaf, own_hash, size.alias("_mix_tokens")), "mix-documents")

    totals = common.written(slim.groupBy(*leaf_cols).agg(F.sum("_mix_tokens").alias("n")), "mix-totals")
    if budget is None:
        budget = int(budget_share * (totals.agg(F.sum("n")).first()[0] or 0))
    targets = allocate(totals.withColumn("cap", F.col("n") * max_epochs), leaf_cols, budget, weights)
    whole = F.when(F.col("n") > 0, F.floor(F.col("target") / F.col("n"))).otherwise(F.lit(max_epochs).cast("long"))
    start = targets.withColumn("_mix_full", whole).withColumn("_mix_rest", F.when(F.col("n") > 0, F.col("target") - F.col("_mix_full") * F.col("n")).otherwise(F.lit(0).cast("long")))
    plan = common.written(start.select(*leaf_cols, "_mix_full", "_mix_rest", F.lit(0).cast("long").alias("_mix_prefix"), F.lit(0).cast("long").alias("_mix_before")), "mix-plan")

    def key() -> Column:
        return F.xxhash64("_mix_hash", F.lit(seed), "_mix_full")

    # A leaf's cut lies among keys whose first digits are its prefix; smaller ones are all in.
    digits, most = 0, CUT_DOCS + 1
    while most > CUT_DOCS and digits < 6:
        rows = slim.join(plan.where("_mix_rest > 0"), leaf_cols).withColumn("_mix_key", key())
        if digits:
            rows = rows.where(F.shiftrightunsigned("_mix_key", 64 - _DIGIT * digits) == F.col("_mix_prefix"))
        digit = F.shiftrightunsigned("_mix_key", 64 - _DIGIT * (digits + 1))
        sums = rows.groupBy(*leaf_cols, "_mix_rest", "_mix_before", digit.alias("d")).agg(F.sum("_mix_tokens").alias("t"), F.count("*").alias("n"))
        to_here = Window.partitionBy(*leaf_cols).orderBy("d")  # at most 256 rows a leaf
        reached = sums.withColumn("upto", F.col("_mix_before") + F.sum("t").over(to_here)).where("upto > _mix_rest")
        cut = reached.groupBy(*leaf_cols).agg(F.min(F.struct("d", (F.col("upto") - F.col("t")).alias("before"), "n")).alias("c"))
        plan = common.written(plan.join(cut, leaf_cols, "left").select(*leaf_cols, "_mix_full", "_mix_rest", F.coalesce("c.d", F.col("_mix_prefix") * 256).alias("_mix_prefix"), F.coalesce("c.before", "_mix_before").alias("_mix_before"), F.col("c.n").alias("_mix_inside")), "mix-plan").drop("_mix_inside")
        most = cut.agg(F.max("c.n")).first()[0] or 0
        digits += 1
    shift = 64 - _DIGIT * digits
    inside = slim.join(plan.where("_mix_rest > 0"), leaf_cols).withColumn("_mix_key", key()).where(F.shiftrightunsigned("_mix_key", shift) == F.col("_mix_prefix"))
    by_key = inside.groupBy(*leaf_cols, "_mix_rest", "_mix_before", "_mix_key").agg(F.sum("_mix_tokens").alias("t"))  # equal rows are one
    upto = F.col("_mix_before") + F.sum("t").over(Window.partitionBy(*leaf_cols).orderBy("_mix_key"))
    last = by_key.withColumn("upto", upto).where("upto <= _mix_rest").groupBy(*leaf_cols).agg(F.max("_mix_key").alias("_mix_cut"))
    decided = common.written(plan.join(last, leaf_cols, "left"), "mix-cuts")

    own = docs.select(F.struct(*docs.columns).alias("row"), *leaf, own_hash)
    placed = own.join(decided, leaf_cols)
    digit = F.shiftrightunsigned(key(), shift)
    partly = (F.col("_mix_rest") > 0) & ((digit < F.col("_mix_prefix")) | ((digit == F.col("_mix_prefix")) & F.coalesce(key() <= F.col("_mix_cut"), F.lit(False))))
    copies = F.col("_mix_full") + F.when(partly, 1).otherwise(0)
    epochs = F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(F.array().cast("array<long>"))
    chosen = placed.select("row", F.explode(epochs.cast("array<int>")).alias("_mix_epoch"))
    return chosen.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "_mix_epoch"), "_mix_epoch")
