"""Connected components of a graph given as a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.storage import stored

#: More links than that are never broadcast: Spark knows them by the size of their file only, which may be far less than that of
#: the rows they become.
FEW_LINKS = 1 << 17


def _stars(links: DataFrame, *, smaller: bool, few: bool) -> DataFrame:
    """One contraction of links (a > b). Large star: every larger neighbour of a node is linked to the least node near it.
    Small star: a node and its smaller neighbours are linked to the least of them. few: whether Spark may broadcast them."""
    if smaller:
        near = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    else:
        near = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
        near = near.select(F.col("x.a").alias("node"), F.col("x.b").alias("other"))
    least = near.groupBy("node").agg(F.min("other").alias("least"))
    least = least.select("node", F.least("node", "least").alias("least"))
    met = (near if few else near.hint("merge")).join(least, "node")
    if smaller:
        moved = met.select(F.col("other").alias("a"), F.col("least").alias("b"))
        own = least.select(F.col("node").alias("a"), F.col("least").alias("b"))
        return moved.union(own).filter("a != b").distinct()
    return met.filter("other > node").select(F.col("other").alias("a"), F.col("least").alias("b")).filter("a != b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Nodes of a table of links (a, b) with the least node of their component: node, component.

    The two contractions alternate until nothing changes; then every node is linked to its least one directly. Each round's
    links are written to the shared folder, which cuts the lineage and survives lost executors. Links of a node with itself
    and repeated links are harmless; nodes without links to others are not returned.
    """
    links = stored(
        links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    count = links.count()
    if not count:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    for _ in range(max_rounds):
        few = count <= FEW_LINKS
        links = stored(_stars(_stars(links, smaller=False, few=few), smaller=True, few=few), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before, count = now, now[0]
    raise RuntimeError(f"components not found in {max_rounds} rounds")
