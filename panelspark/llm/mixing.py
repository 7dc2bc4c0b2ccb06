"""Mixing sources to target weights by capped water-filling and seeded repetition.

Each source gets words in proportion to its weight, but never more than ``max_epochs``
times its size; what a capped source can't take is shared again by weight.  The level of
the water is found on the table of sources, the repetitions on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import count_words
from panelspark.session import materialize

WEIGHTS = (5, 2, 1)
#: How often the gap below a target is filled again with what fits.
ROUNDS = 4
#: Sources up to which a table of them is broadcast.
MAX_SENT = 100_000


def draw_order(seed: int, doc_id: Column, key: Column) -> Column:
    """A seeded order of the documents: the hex MD5 of ``seed:doc_id``; without an id, of the row key."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("#"), key.cast("string")))
    return F.md5(F.concat(F.lit(f"{seed}:"), name))


def row_key(doc_id: Column, source: Column, text: Column) -> Column:
    """A hash that rows share only if they agree in all three, nulls told from empty texts."""
    missing = F.concat_ws("", *[c.isNull().cast("string") for c in (doc_id, source, text)])
    return F.xxhash64(missing, doc_id, source, text)


def sized_rows(docs: DataFrame) -> DataFrame:
    """(key, doc_id, source, size) of every row, stored."""
    doc_id = F.col("doc_id").cast("long")
    key = row_key(doc_id, F.col("source"), F.col("text"))
    return materialize(docs.select(key.alias("key"), doc_id.alias("doc_id"), "source", count_words(F.col("text")).alias("size")), "sizes")


def _per_source(rows: DataFrame) -> DataFrame:
    """A stored table of a row a source: broadcast unless there are very many of them."""
    return F.broadcast(rows) if rows.count() <= MAX_SENT else rows


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = 150, max_epochs: int = 2
) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources in code point order, null last, take the weights in turn.  The budget is
    ``share_percent`` of all sizes.  In order of ``max_epochs * size / weight`` the capped
    sources come first: a source is capped while the level that the rest of the budget
    gives the uncapped ones lies above its own ratio.  A source without words gets 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long")
    rows = sizes.withColumn("weight", weight)
    ratio = F.col("source_size") * max_epochs / F.col("weight")
    by_ratio = Window.orderBy("__ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        rows.withColumn("__ratio", ratio)
        .withColumn("__total", F.sum("source_size").over(whole))
        .withColumn("__weights", F.sum("weight").over(whole))
        .withColumn("__used", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_epochs)
        .withColumn("__left", F.col("__weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("__level", (F.col("__total") * share_percent / 100 - F.col("__used")) / F.col("__left"))
        # the first source that its own level leaves below its cap sets the level for all
        .withColumn("__water", F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", (-F.col("__left")).alias("__order"), "__level"))).over(whole))
    )
    capped = (F.col("source_size") * max_epochs).cast("double")
    target = F.when(F.col("__water").isNull() | (F.col("__ratio") < F.col("__water.__ratio")), capped).otherwise(
        F.least(capped, F.col("__water.__level") * F.col("weight"))
    )
    return level.select("source", "source_size", "weight", target.alias("target"))


def _fill(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Takes further rows, in seeded order, until the next one would pass the source's gap.

    Rows larger than the gap are passed over.  Whole slots of the order are summed first
    and only the rows of the slot that holds the cut are put in order, so no source is
    gathered in one task and the sums are exact at every size.
    """
    used = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("extra")).alias("used"))
    used = used.withColumnRenamed("source", "__used_source")
    gaps = goals.join(used, F.col("__source").eqNullSafe(F.col("__used_source"))).select(
        "__source", (F.col("rest") - F.col("used")).alias("gap")
    )
    gaps = _per_source(materialize(gaps, "mix-gaps"))
    fits = (F.col("extra") == 0) & (F.col("size") > 0) & (F.col("size") <= F.col("gap"))
    same = F.col("source").eqNullSafe(F.col("__source"))
    slots = rows.join(gaps, same).filter(fits).groupBy("source", "gap", "slot").agg(F.sum("size").alias("s"))
    slots = slots.withColumn("upto", F.sum("s").over(Window.partitionBy("source", "gap").orderBy("slot")))
    cuts = slots.filter("upto > gap").groupBy("source").agg(
        F.min(F.struct("slot", (F.col("upto") - F.col("s")).alias("before"))).alias("c")
    )
    cuts = cuts.select(F.col("source").alias("__cut_source"), F.col("c.slot").alias("cut"), F.col("c.before").alias("before"))
    gaps = gaps.join(cuts, F.col("__source").eqNullSafe(F.col("__cut_source")), "left").drop("__cut_source")
    gaps = _per_source(materialize(gaps, "mix-cuts"))
    placed = rows.join(gaps, same)
    at_cut = fits & F.coalesce(F.col("slot") == F.col("cut"), F.lit(False))
    in_order = Window.partitionBy("source").orderBy("order", "doc_id", "size", "key")
    in_order = in_order.rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("size").over(in_order)
    edge = placed.filter(at_cut).withColumn("extra", (upto <= F.col("gap")).cast("int"))
    below = fits & F.coalesce(F.col("slot") < F.col("cut"), F.lit(True))
    clear = placed.filter(~at_cut).withColumn("extra", F.when(below, 1).otherwise(F.col("extra")))
    return materialize(clear.unionByName(edge).select(*rows.columns), "mix-rows")


def repetitions(sized: DataFrame, targets: DataFrame, seed: int = 7, rounds: int = ROUNDS) -> DataFrame:
    """Adds source_size, target and ``times``, how often the mix takes a row, to the sized rows.

    A source takes all its rows floor(target / size) times.  What is left of the target
    is filled with whole documents in a seeded order; ``rounds`` times what still fits in
    the gap that a too large document leaves is filled in the same way.
    """
    order = draw_order(seed, F.col("doc_id"), F.col("key"))
    rows = sized.withColumn("order", order).withColumn("extra", F.lit(0))
    rows = rows.withColumn("slot", F.conv(F.substring("order", 1, 4), 16, 10).cast("int"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = targets.withColumn("whole", whole.cast("long")).select(
        F.col("source").alias("__source"), "source_size", "target", "whole",
        F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long").alias("rest"),
    )
    goals = _per_source(materialize(goals, "mix-goals"))
    for _ in range(rounds):
        rows = _fill(rows, goals)
    counted = rows.join(goals, F.col("source").eqNullSafe(F.col("__source")))
    times = (F.col("whole") + F.col("extra")).cast("long")
    return counted.select("key", "doc_id", "source", "size", "source_size", "target", times.alias("times"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = 150, max_epochs: int = 2, seed: int = 7
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``.

    Null or wordless texts have size 0 and are taken as often as their source says, which
    adds nothing.  Repeated rows count each on its own.  No rows give none.
    """
    sized = sized_rows(docs)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share_percent, max_epochs)
    counted = repetitions(sized, targets, seed)
    return counted.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_rows(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = 150, max_epochs: int = 2, seed: int = 7
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows taken 0 times go.

    Rows that agree in doc_id, source and text, such as repeated ones, share evenly what
    the mix takes of them together; rows without a doc_id are told apart by their texts.
    """
    sized = sized_rows(docs)
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    counted = repetitions(sized, source_targets(sizes, weights, share_percent, max_epochs), seed)
    taken = counted.groupBy(F.col("key").alias("__key")).agg(F.sum("times").alias("__times"), F.count("*").alias("__rows"))
    key = row_key(F.col("doc_id").cast("long"), F.col("source"), F.col("text"))
    met = docs.withColumn("__row", key).join(taken.filter("__times > 0"), F.col("__row") == F.col("__key"))
    # several rows of one key: the first ones take what does not divide evenly
    place = F.row_number().over(Window.partitionBy("__row").orderBy("__row"))
    more = F.when(F.col("__rows") > 1, (place <= F.col("__times") % F.col("__rows")).cast("int")).otherwise(0)
    times = F.floor(F.col("__times") / F.col("__rows")) + more
    found = met.withColumn("__times", times.cast("int")).filter("__times > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__copy")
    return found.select(*docs.columns, copies).drop("__copy")
