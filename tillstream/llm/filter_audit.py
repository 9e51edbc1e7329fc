"""How document filters interact: what each removes in every order in which they can be applied.

A document's failures are one mask, a bit for each filter. Documents are counted by part and mask, so
whatever their number a part has at most 32 cells. Each cell is folded with higher-order functions
across the broadcast array of all orders: ``transform`` over the orders, ``aggregate`` along each
order, where the first filter that the mask fails removes the cell and later failures are redundant.
That gives 600 structs, weighted with the cell's counts; a part's cells are merged by elementwise sums.

Equal texts fail the same conditions, but only the smallest id among them passes the last filter. The
rows meet the smallest ids by text and id together, so that no group of copies is one key.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.session import written

FILTERS = "ABCDE"
# The conditions' limits.
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5

_SPACE = r"[\x20\x09-\x0D]+"
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
_STEP = "struct<filter:int," + ",".join(f"{name}:bigint" for name in _COUNTS) + ">"


def _bit(filter_name: str, fails: Column) -> Column:
    return F.when(fails, F.lit(1 << FILTERS.index(filter_name))).otherwise(F.lit(0))


def text_mask(text: Column) -> Column:
    """The bits of the conditions A to D, which a text fails by itself."""
    words = F.array_remove(F.split(text, _SPACE), "")
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return (
        _bit("A", F.size(words) < LEAST_WORDS)
        + _bit("B", 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words))
        + _bit("C", 100 * capitals.cast("long") > CAPITAL_PERCENT * F.length(text))
        + _bit("D", text.rlike("[#$%&*|]"))
    )


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row; the texts are read once and reduced to a digest."""
    text = F.coalesce("text", F.lit(""))
    rows = written(
        docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
        .select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_mask(F.col("text")).alias("mask")),
        "masks",
    )
    named = rows.where(F.col("doc_id").isNotNull())
    first = named.groupBy("digest").agg(F.min("doc_id").alias("first_id")).select(
        F.col("digest").alias("first_digest"), "first_id"
    )
    met = named.join(first, (F.col("digest") == F.col("first_digest")) & (F.col("doc_id") == F.col("first_id")), "left")
    return met.select("doc_id", "part", (F.col("mask") + _bit("E", F.col("first_id").isNull())).alias("mask")).unionByName(
        rows.where(F.col("doc_id").isNull()).select("doc_id", "part", "mask")
    )


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): the documents of each part by what they fail."""
    found = failures(docs)
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    named = found.where(F.col("doc_id").isNotNull()).join(marked, F.col("doc_id") == F.col("label_id"), "left")
    unnamed = found.where(F.col("doc_id").isNull()).select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return named.select("part", "mask", "good", "toxic").unionByName(unnamed).groupBy("part", "mask").agg(
        F.count("*").alias("docs"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
    )


def all_orders(spark: SparkSession, filters: int = len(FILTERS)) -> DataFrame:
    """One row: the array of all orders, each an array of filter numbers."""
    return spark.createDataFrame([([list(order) for order in permutations(range(filters))],)], "orders array<array<int>>")


def _folded(order: Column) -> Column:
    """The steps of one order for a cell: the cell is there until the first filter that it fails."""
    nothing = F.struct(F.lit(False).alias("gone"), F.array().cast(f"array<{_STEP}>").alias("steps"))

    def counted(happens: Column, count: str = "docs") -> Column:
        return F.when(happens, F.col(count)).otherwise(F.lit(0).cast("bigint"))

    def step(state: Column, number: Column) -> Column:
        fails, gone = F.getbit("mask", number) == 1, state["gone"]
        removed = fails & ~gone
        made = F.struct(
            number.alias("filter"),
            counted(~fails & ~gone).alias("kept"),
            counted(removed).alias("removed"),
            counted(fails & gone).alias("redundant"),
            counted(fails & (F.bit_count("mask") == 1)).alias("unique_fails"),
            counted(removed, "good").alias("good_lost"),
            counted(removed, "toxic").alias("toxic_lost"),
        )
        return F.struct((gone | fails).alias("gone"), F.concat(state["steps"], F.array(made)).alias("steps"))

    return F.aggregate(order, nothing, step, lambda state: state["steps"])


def _summed(left: Column, right: Column) -> Column:
    """Elementwise sums of two arrays of steps of the same orders."""
    return F.zip_with(
        left, right,
        lambda a, b: F.struct(a["filter"].alias("filter"), *[(a[name] + b[name]).alias(name) for name in _COUNTS]),
    )


def order_effects(counted: DataFrame, orders: DataFrame) -> DataFrame:
    """One row for each part, order and step, from the cells and the array of orders.

    ``shapley`` is what the step's filter removes at any step, summed over all orders.
    """
    # The array of orders is one row. A part has a cell for each mask that occurs, so its list is short.
    folded = counted.join(F.broadcast(orders)).select(
        "part", F.flatten(F.transform("orders", _folded)).alias("steps")
    )
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("cells")).select(
        "part",
        F.aggregate(F.slice("cells", 2, 1 << len(FILTERS)), F.col("cells")[0], _summed).alias("steps"),
    )
    removed = F.transform(
        F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)),
        lambda number: F.aggregate(
            F.filter("steps", lambda s: s["filter"] == number), F.lit(0).cast("bigint"), lambda total, s: total + s["removed"]
        ),
    )
    letters = F.array(*map(F.lit, FILTERS))
    names = F.transform("orders", lambda order: F.array_join(F.transform(order, lambda n: F.get(letters, n)), ""))
    placed = (
        merged.select("part", removed.alias("removed_by"), F.posexplode("steps").alias("at", "step_counts"))
        .join(F.broadcast(orders.select(names.alias("names"))))
    )
    return placed.select(
        "part",
        F.get("names", F.floor(F.col("at") / len(FILTERS)).cast("int")).alias("filter_order"),
        (F.col("at") % len(FILTERS) + 1).cast("int").alias("step"),
        *[F.col(f"step_counts.{name}").alias(name) for name in _COUNTS],
        F.get("removed_by", F.col("step_counts.filter")).alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, counts, shapley): 600 rows for each value of ``source``.

    A null source is the part of the empty string, a null text is empty. A row without an id is compared
    with no other's text and has no labels; rows of one id with the same text, the same row twice
    included, are no copies of each other. Of several labels of one id the highest counts. Of
    ``docs`` only ``doc_id``, ``source`` and ``text`` are read, so other columns cannot clash; an empty
    table has no parts and gives no rows.
    """
    return order_effects(cells(docs, labels), all_orders(docs.sparkSession))
