"""Mixing of sources to target weights, in DataFrame functions only.

Every document gets a random key, the hash of its id. Within its source, documents are put in the order of their keys in ranges
(the first digits of the key), sums of sizes are taken per range, summed up over the ranges of a source, and continued inside
each range: a prefix sum that no source holds in one task, however hot it is. The source is cut where its sum reaches its budget,
after as many whole epochs as the budget has.

Targets: each source's share of the total by weight, but no more than max_epochs times its size; what is above is shared by
weight among the others until none is above. That is the level at which min(cap, weight x level) sums to the total, found in
the table of sources, which has a row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.llm.storage import stored

WORD = r"[^\x20\x09-\x0D]+"
KEY_DIGITS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_col: str, seed: str) -> Column:
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.substring(F.md5(F.concat(ident, F.lit(":"), F.lit(seed))), 1, KEY_DIGITS)


def source_targets(
    sources: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2
) -> DataFrame:
    """Adds target to a table of sources (source, source_size), a row per source.

    Weights are dealt out in the order of the sources by code point, null last, and repeat. The share of all sizes is the total;
    it can't be above max_epochs, since no source is repeated more often.
    """
    if share > max_epochs:
        raise ValueError("the share asked for is more than max_epochs allow")
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place - 1) % len(weights) + 1))
    weighed = weighed.withColumn("cap", F.col("source_size") * max_epochs)
    filling = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    rest = filling.rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.lit(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    found = weighed.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    # The level is that of the first source whose cap is not reached; caps are reached in the order of cap / weight.
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    final = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    return found.withColumn(
        "target", F.least(F.col("cap").cast("double"), F.coalesce(final * F.col("weight"), F.col("cap").cast("double")))
    ).select("source", "source_size", "target")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix",
    ranges: int = 4096,
) -> DataFrame:
    """How often the mix takes each document.

    Returns id_col, source_col, key, size (words), source_size, target and epochs (of its source), copies and taken (copies x
    size), a row per row of docs. Copies are the source's whole epochs, and one more for the documents whose middle lies before the
    rest of the budget in the order of the keys: a source's taken words miss its target by at most half its largest document.
    Ties of the key go by id (null first), then by size; rows equal in these are alike. A null text has size 0, null is a source
    of its own, a source without words takes nothing. ranges is a power of 16.
    """
    digits = len(f"{ranges:x}") - 1
    if 16**digits != ranges:
        raise ValueError("ranges must be a power of 16")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        random_key(id_col, seed).alias("key"),
    ).withColumn("range", F.substring("key", 1, digits))
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(
        sums.groupBy("source").agg(F.sum("range_size").alias("source_size")),
        weights=weights,
        share=share,
        max_epochs=max_epochs,
    )
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "range", F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("before"))
    sums = sums.withColumnsRenamed({"source": "s", "range": "r"})
    targets = targets.withColumnRenamed("source", "t")
    budgets = sums.join(targets, F.col("s").eqNullSafe(F.col("t"))).drop("t")
    own = W.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("inside", F.sum("size").over(own))
    # A row per source and range, at most ranges x sources: less than the documents, and joined by shuffle if large.
    placed = placed.join(budgets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    placed = placed.withColumn("epochs", epochs.cast("long"))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    once_more = (rest > 0) & (F.col("before") + F.col("inside") - F.col("size") / 2 <= rest)
    copies = F.least(F.col("epochs") + once_more.cast("long"), F.lit(max_epochs).cast("long"))
    return placed.withColumn("copies", copies).select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "key",
        "size",
        "source_size",
        "target",
        "epochs",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def take(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: int = 2,
    seed: str = "mix",
    ranges: int = 4096,
) -> DataFrame:
    """The mix itself: every row of docs, with all its columns, as often as the mix takes it.

    The rows taken once more are the first of their source in the order of the keys, so that each source has a last place; rows are
    compared with it where they lie, and texts are not shuffled. If the cut falls between rows alike in key, id and size, only these
    are numbered: equal ones are counted first, and different ones go by the hash of all their columns. So the mix has exactly the
    words that `mix` counts. Columns must be comparable (no maps).
    """
    mixed = mix(
        docs,
        id_col=id_col,
        text_col=text_col,
        source_col=source_col,
        weights=weights,
        share=share,
        max_epochs=max_epochs,
        seed=seed,
        ranges=ranges,
    )
    place = F.struct("key", F.col(id_col).alias("id"), "size")
    more = F.when(F.col("copies") > F.col("epochs"), place)
    by_place = mixed.groupBy(F.col(source_col).alias("source"), place.alias("place")).agg(
        F.max("epochs").alias("epochs"), F.max(more).alias("more"), F.count(more).alias("taken"), F.count("*").alias("tied")
    )
    last = by_place.groupBy("source").agg(
        F.max("epochs").alias("epochs"), F.max(F.struct("more", "taken", "tied")).alias("last")
    )
    # A row per source; as a stored table its size is known to Spark, which broadcasts it only below its threshold.
    cuts = stored(last.select("source", "epochs", "last.*"), "cuts")
    own = F.struct(
        random_key(id_col, seed).alias("key"), F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size")
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), own.alias("own"), F.col(source_col).alias("of"))
    met = rows.join(cuts, F.col("of").eqNullSafe(F.col("source")))
    split = (F.col("own") == F.col("more")) & (F.col("taken") < F.col("tied"))
    split = F.coalesce(split, F.lit(False))
    copies = F.col("epochs") + F.coalesce((F.col("own") <= F.col("more")).cast("long"), F.lit(0).cast("long"))
    copied = met.filter(~split).select("row", copies.alias("copies"))
    if not cuts.filter("taken < tied").isEmpty():
        alike = met.filter(split).groupBy("source", "epochs", "taken", "row").agg(F.count("*").alias("rows"))
        before = W.partitionBy("source").orderBy(F.xxhash64("row"), "row").rowsBetween(W.unboundedPreceding, -1)
        rest = F.col("taken") - F.coalesce(F.sum("rows").over(before), F.lit(0))
        once_more = F.greatest(F.least("rows", rest), F.lit(0).cast("long"))
        copied = copied.union(alike.select("row", (F.col("rows") * F.col("epochs") + once_more).alias("copies")))
    taken = copied.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return taken.select("row.*")
