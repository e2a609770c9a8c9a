"""Exact top-k by inner product: best-first search in M-trees.

The largest inner products are the nearest neighbours in a metric space: each candidate gets one more component, which brings
all candidates to the length of the longest, and queries get a zero there. Then the squared distance is a constant of the query
less twice the inner product.

Candidates are dealt by a hash of their id to trees of bounded size, so that copies of one vector spread over all trees; in a
tree, equal vectors are one entry with the k + 1 smallest of their ids, which is all that a top-k can need. A tree is a list of
pages. An inner page has routing vectors with covering radius, distance to the parent's routing vector, and child page; a leaf
page has vectors with their distance to its routing vector. A search takes pages from a queue by their least possible distance;
an entry whose stored distance to the parent differs from the query's by too much is skipped without computing its own.

Queries are dealt to blocks of bounded size; each task searches one tree for one block, and the trees' results are merged.
"""

from __future__ import annotations

import heapq
import pickle
from math import ceil, sqrt
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.llm.storage import stored

PAGE = 256
FAN = 16
TREE_ROWS = 8192
QUERY_ROWS = 2048
#: Share of the distances that rounding may cost; bounds are loosened by it, results are exact integers.
SLACK = 1e-7


class Tree:
    """M-tree over distinct integer vectors. ids: for each vector its smallest ids, in order."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], longest2: float):
        self.longest2 = longest2
        self.vectors, self.ids = vectors, ids
        self.points = vectors.astype(np.float64)
        self.lift = np.sqrt(np.maximum(longest2 - (self.points**2).sum(1), 0))
        self.pages: list[dict[str, Any]] = []
        self.root = self._page(np.arange(len(vectors)), None)
        # Products of vectors within this length are whole numbers that floating point holds exactly.
        self.exact = longest2 < 2.0**50
        for page in self.pages:
            held = page["rows"] if "rows" in page else page["routes"]
            page["points"] = self.points[held] if self.exact else vectors[held]
        del self.points, self.lift, self.vectors

    def to_bytes(self) -> bytes:
        return pickle.dumps(self.__dict__)

    @classmethod
    def from_bytes(cls, stored_pages: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.__dict__.update(pickle.loads(stored_pages))
        return tree

    def _distance(self, rows: np.ndarray, to: int) -> np.ndarray:
        gap = self.points[rows] - self.points[to]
        return np.sqrt((gap**2).sum(1) + (self.lift[rows] - self.lift[to]) ** 2)

    def _page(self, rows: np.ndarray, parent: int | None) -> int:
        """Adds the page of these vectors, after the pages below it; its number."""
        if len(rows) <= PAGE:
            routed = np.zeros(len(rows)) if parent is None else self._distance(rows, parent)
            self.pages.append({"rows": rows, "routed": routed})
            return len(self.pages) - 1
        routes = rows[np.linspace(0, len(rows) - 1, min(FAN, ceil(len(rows) / PAGE))).astype(int)]
        distance = np.stack([self._distance(rows, r) for r in routes])
        nearest = distance.argmin(0)
        children, radius, used = [], [], []
        for i, route in enumerate(routes):
            near = nearest == i
            if near.any():
                used.append(route)
                radius.append(distance[i, near].max())
                children.append((rows[near], route))
        if len(children) == 1:  # no route parts them: halves
            half = len(rows) // 2
            children = [(rows[:half], used[0]), (rows[half:], used[0])]
            used, radius = used * 2, radius * 2
        routed = np.zeros(len(used)) if parent is None else self._distance(np.array(used), parent)
        below = np.array([self._page(r, route) for r, route in children])
        self.pages.append({"routes": np.array(used), "radius": np.array(radius), "routed": routed, "below": below})
        return len(self.pages) - 1

    def search(self, query: np.ndarray, k: int, own: int) -> list[tuple[int, int]]:
        """The k best (-score, id), without the query's own id."""
        wide = query.astype(np.float64)
        asked = wide if self.exact and float(wide @ wide) < 2.0**50 else query
        constant = float(wide @ wide) + self.longest2
        slack = SLACK * sqrt(constant) + 1e-9
        best: list[tuple[int, int]] = []
        within = float("inf")
        queue: list[tuple[float, int, float]] = [(0.0, self.root, -1.0)]
        while queue:
            least, number, at = heapq.heappop(queue)
            if least > within + slack:
                break
            page = self.pages[number]
            reach = page.get("radius", 0.0)
            # The root has no routing vector, so nothing is known before its entries' own distances.
            open_ = np.abs(page["routed"] - at) - reach <= within + slack if at >= 0 else slice(None)
            open_ = slice(None) if at >= 0 and open_.all() else open_
            if "rows" in page:
                rows, scores = page["rows"][open_], page["points"][open_] @ asked
                if len(best) == k:
                    enough = np.flatnonzero(scores >= -best[-1][0])
                    rows, scores = rows[enough], scores[enough]
                if len(rows):
                    found = [(-int(s), int(i)) for r, s in zip(rows, scores, strict=True) for i in self.ids[r] if i != own]
                    best = heapq.nsmallest(k, best + found)
                    if len(best) == k:
                        within = sqrt(max(constant + 2.0 * best[-1][0], 0.0))
                continue
            distance = np.sqrt(np.maximum(constant - 2.0 * (page["points"][open_] @ wide), 0))
            bounds = np.maximum(distance - page["radius"][open_], least)
            for bound, child, d in zip(bounds.tolist(), page["below"][open_].tolist(), distance.tolist(), strict=True):
                if bound <= within + slack:
                    heapq.heappush(queue, (bound, child, d))
        return best


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (floor of 256 times each component) of the rows whose id, vector and components are present and finite."""
    value = F.col(vector_col).cast("array<double>")

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(value, finite)
    return rows.filter(usable).select(
        F.col(id_col).cast("long").alias("id"), F.transform(value, lambda x: F.floor(x * 256)).alias("vector")
    )


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return out


def build_trees(vectors: DataFrame, trees: int, longest2: float, width: int, k: int) -> DataFrame:
    """A row per tree: tree (number) and pages (the tree's state, pickled)."""

    def built(key: tuple[int], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        distinct, of = np.unique(_matrix(rows["vector"], width), axis=0, return_inverse=True)
        order = np.argsort(of.ravel(), kind="stable")
        cuts = np.searchsorted(of.ravel()[order], np.arange(1, len(distinct)))
        ids = [np.unique(x)[: k + 1] for x in np.split(rows["id"].to_numpy()[order], cuts)]
        return pd.DataFrame({"tree": [key[0]], "pages": [Tree(distinct, ids, longest2).to_bytes()]})

    dealt = vectors.withColumn("tree", F.pmod(F.xxhash64("id"), F.lit(trees)).cast("int"))
    return dealt.groupBy("tree").applyInPandas(built, "tree int, pages binary")


def search_trees(trees: DataFrame, queries: DataFrame, n_trees: int, blocks: int, width: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each tree for each query."""

    def searched(_: tuple[int, int], tree: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(tree) and len(block):
            index = Tree.from_bytes(tree["pages"].iloc[0])
            for own, vector in zip(block["id"], _matrix(block["vector"], width), strict=True):
                found += [(own, ident, -score) for score, ident in index.search(vector, k, own)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    each = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
    grouped = each.groupBy("tree", "block").cogroup(asked.groupBy("tree", "block"))
    return grouped.applyInPandas(searched, "query_id long, vec_id long, score long")


def top_k(
    rows: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    tree_rows: int = TREE_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The k rows of highest integer inner product for each row that is_query (a condition on the column `id`) chooses.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id, the query's own id never is an answer, fewer
    than k candidates give all. Rows with a null id, a null vector, or a component that is null or not finite take no part;
    shorter vectors count as filled up with zeros; a row that repeats another one's id and vector is no further candidate, and one that
    repeats a query's id no further query (that with the least vector is it). Other columns are left out, an empty table gives an
    empty one.
    """
    vectors = stored(whole_vectors(rows, id_col, vector_col), "vectors")
    length2 = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, asked, longest2, width = vectors.agg(
        F.count("*"), F.count_if(is_query), F.coalesce(F.max(length2), F.lit(0.0)), F.coalesce(F.max(F.size("vector")), F.lit(0))
    ).first()
    n_trees, blocks = max(1, ceil(n / tree_rows)), max(1, ceil(asked / query_rows))
    trees = stored(build_trees(vectors, n_trees, longest2, width, k), "trees")
    queries = vectors.filter(is_query).groupBy("id").agg(F.min("vector").alias("vector"))
    found = search_trees(trees, queries, n_trees, blocks, width, k)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
