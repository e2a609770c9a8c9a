"""Grouping of spelling variants: words that differ by one inserted, deleted or replaced code point.

Words are counted by Spark's own expressions. Two different words are near if their common prefix and their common suffix together
reach the longer length less one. The words lie as rows in padded matrices of code points, once flush left and once flush right, and
two blocks of rows are compared as a tile, column by column, for all pairs at once.

Which blocks meet: let m be the length of the longer of two near words. Cut m into SEGMENTS parts; the edit falls into one of them,
and all before it and all behind it agree. So a word is filed under its length and the next one as m, and under each part, by what
lies before and behind the part. Words of one key are a group; small groups share a tile, and a large one is cut into blocks by a
hash of the word, whose pairs are tiles of their own, dealt over all tasks. A near pair shares the key of the part in which the
first difference lies, and counts there only.

A tile returns one row per word that has near words, with their number and the best of them, never the pairs.

Rows without text have no words; a null id counts as an empty text; repeated rows count as often as they occur; texts and words may be
of any length; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, log2, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.storage import bound_batches, stored

LETTERS = "[A-Za-zÀ-ÿ]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEGMENTS = 4
#: Rows of a block within a tile, and code points of a block.
BLOCK = 128
BLOCK_CODES = 1 << 20
#: Words of a key that are compared in one piece; a larger group is cut into blocks of about this size.
GROUP = 2048
#: Keys of large groups that are broadcast; more of them are joined by a shuffle.
BROADCAST_KEYS = 100_000

FOUND = "word string, n_near long, other_n long, other string"


def words_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 7, drop_every: int = 31) -> DataFrame:
    """word and n: all runs of letters in lower case (A-Z only), of at least `least` code points. Of the runs whose crc32 with their
    document's id is divisible by drop_every, the code point of that number is left out first."""
    # A run that is too short can't become long enough.
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    named = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    lowered = named.select("id", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    word = F.when(F.col("h") % drop_every == 0, shorter).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def _filed(words: DataFrame) -> DataFrame:
    """Each word under its keys: key, m, part, word, n."""
    keys = []
    for longer in (0, 1):
        m = F.char_length("word") + longer
        for part in range(SEGMENTS):
            first, past = (F.floor(m * p / SEGMENTS).cast("int") for p in (part, part + 1))
            before, behind = F.substring(F.col("word"), F.lit(1), first), F.right(F.col("word"), m - past)
            key = F.xxhash64(m, F.lit(part), before, behind)
            keys.append(F.struct(key.alias("key"), m.alias("m"), F.lit(part).alias("part")))
    return words.select(F.explode(F.array(*keys)).alias("k"), "word", "n").select("k.*", "word", "n")


def _tiles(filed: DataFrame) -> DataFrame:
    """The filed words with the tile they belong to: i, j (blocks of their group) and side, 1 for rows of block j."""
    sizes = filed.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > GROUP)
    large = stored(sizes.select("key", F.ceil(F.col("size") / GROUP).cast("int").alias("blocks")), "large-groups")
    n = large.count()
    one = filed.select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    if n == 0:
        return one
    dealt = filed.join(F.broadcast(large) if n <= BROADCAST_KEYS else large, "key", "left")
    block = F.pmod(F.xxhash64("word"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = dealt.select(*filed.columns, block.alias("own"), F.coalesce("blocks", F.lit(1)).alias("blocks"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met"))
    i, j = F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j")
    return met.select(*filed.columns, i, j, (F.col("met") < F.col("own")).cast("int").alias("side"))


class _Block:
    """Words as padded matrices of code points, flush left and flush right."""

    def __init__(self, words: list[str], n: np.ndarray, key: np.ndarray, m: np.ndarray, part: np.ndarray):
        self.words, self.n, self.key, self.m, self.part = words, n, key, m, part
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.left, self.right = self._matrix(words), self._matrix([w[::-1] for w in words])
        # Best first: largest n, then code-point order.
        self.rank = np.empty(len(words), np.int64)
        self.rank[sorted(range(len(words)), key=lambda i: (-n[i], words[i]))] = np.arange(len(words))
        self.from_, self.to = m * part // SEGMENTS, m * (part + 1) // SEGMENTS

    @staticmethod
    def _matrix(words: list[str]) -> np.ndarray:
        """A column per code point, so that a column is contiguous."""
        codes = np.array(words).view(np.uint32).reshape(len(words), -1)
        return np.ascontiguousarray((codes.astype(np.uint8) if codes.max(initial=0) < 256 else codes).T)


def _common(a: np.ndarray, b: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Number of equal leading columns of each pair of rows that is alive."""
    alive = alive.copy()
    total = np.zeros(alive.shape, np.int32)
    for x, y in zip(a, b, strict=False):
        alive &= x[:, None] == y[None, :]
        if not alive.any():
            break
        total += alive
    return total


def _near(a: _Block, b: _Block, same: bool) -> np.ndarray:
    """Which rows of two blocks are near words and counted under their key."""
    longer = np.maximum(a.length[:, None], b.length[None, :])
    met = (a.key[:, None] == b.key[None, :]) & (longer == a.m[:, None]) & (longer == b.m[None, :])
    met &= a.part[:, None] == b.part[None, :]
    if same:
        np.fill_diagonal(met, False)
    if not met.any():
        return met
    prefix = _common(a.left, b.left, met)
    met &= (prefix >= a.from_[:, None]) & (prefix < a.to[:, None])
    return met & (prefix + _common(a.right, b.right, met) >= longer - 1)


def _best(near: np.ndarray, a: _Block, b: _Block) -> list[tuple[str, int, int, str]]:
    """For each row of a that has near rows in b: word, their number, and the best of them."""
    counts = near.sum(1)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return []
    best = np.where(near[rows], b.rank[None, :], len(b.rank)).argmin(1)
    return [(a.words[r], int(counts[r]), int(b.n[o]), b.words[o]) for r, o in zip(rows, best, strict=True)]


def _blocks(columns: dict[str, np.ndarray], words: list[str], first: int, past: int) -> list[_Block]:
    """Rows first to past in blocks of bounded size."""
    bounds, width = [first], 0
    for i in range(first, past):
        width = max(width, len(words[i]))
        rows = i - bounds[-1]
        if rows and (rows >= BLOCK or (rows + 1) * width > BLOCK_CODES):
            bounds.append(i)
            width = len(words[i])
    held = [columns[c] for c in ("n", "key", "m", "part")]
    return [_Block(words[a:b], *(c[a:b] for c in held)) for a, b in zip(bounds, [*bounds[1:], past], strict=True) if a < b]


def _pairs_of(left: list[_Block], right: list[_Block] | None) -> Iterator[tuple[str, int, int, str]]:
    """What a tile finds: blocks against each other, or against themselves and all that follow."""
    for x, a in enumerate(left):
        if right is None:
            yield from _best(_near(a, a, same=True), a, a)
        for b in left[x + 1 :] if right is None else right:
            near = _near(a, b, same=False)
            yield from _best(near, a, b)
            yield from _best(near.T, b, a)


def _starts(columns: dict[str, np.ndarray]) -> np.ndarray:
    """First rows of the groups."""
    turns = (np.diff(columns["key"]) != 0) | (np.diff(columns["i"]) != 0) | (np.diff(columns["j"]) != 0)
    return np.concatenate([[0], np.flatnonzero(turns) + 1])


def _compared(columns: dict[str, np.ndarray], words: list[str]) -> Iterator[tuple[str, int, int, str]]:
    """Near words of whole groups, in order of key, i, j, side."""
    starts = [*_starts(columns).tolist(), len(words)]
    crossed = columns["i"] != columns["j"]
    spans: list[tuple[int, int]] = []
    for first, past in zip(starts, starts[1:], strict=False):
        # Small groups share a span; pairs of different keys don't count there. Two blocks of a large group stay apart.
        if spans and past - spans[-1][0] <= BLOCK and not crossed[first] and not crossed[spans[-1][0]]:
            spans[-1] = (spans[-1][0], past)
        else:
            spans.append((first, past))
    for first, past in spans:
        if crossed[first]:
            split = first + int(np.searchsorted(columns["side"][first:past], 1))
            yield from _pairs_of(_blocks(columns, words, first, split), _blocks(columns, words, split, past))
        elif past - first > 1:
            yield from _pairs_of(_blocks(columns, words, first, past), None)


NUMBERS = ("key", "i", "j", "side", "m", "part", "n")


def _found_rows(rows: Iterator[tuple[str, int, int, str]]) -> pa.RecordBatch:
    word, n_near, other_n, other = zip(*rows, strict=True) if (rows := list(rows)) else ((), (), (), ())
    arrays = [pa.array(word, pa.string()), pa.array(n_near, pa.int64()), pa.array(other_n, pa.int64()), pa.array(other, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["word", "n_near", "other_n", "other"])


def _compare_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows; a group that goes on in the next batch waits for it."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        columns = {c: table.column(c).to_numpy().astype(np.int64) for c in NUMBERS}
        last = int(_starts(columns)[-1]) if table.num_rows else 0
        held = table.slice(last)
        if last:
            yield _found_rows(_compared({c: v[:last] for c, v in columns.items()}, table.column("word").slice(0, last).to_pylist()))
    if held is not None and held.num_rows:
        columns = {c: held.column(c).to_numpy().astype(np.int64) for c in NUMBERS}
        yield _found_rows(_compared(columns, held.column("word").to_pylist()))


def near_words(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Distinct words (word, n) with n_near, the number of near words, and form and form_n: of the near words that of largest n, ties
    by the smallest, if its n is at least ratio times the word's; else null."""
    tiles = _tiles(_filed(words)).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    found = tiles.mapInArrow(_compare_sorted, FOUND)
    # A word and what its tiles found meet in one aggregate.
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("n_near", "long"), ("other_n", "long"), ("other", "string"))]
    rows = words.select("word", "n", *nothing).unionByName(found.select("word", F.lit(None).cast("long").alias("n"), *found.columns[1:]))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))))
    met = rows.groupBy("word").agg(F.max("n").alias("n"), F.coalesce(F.sum("n_near"), F.lit(0)).alias("n_near"), best.alias("best"))
    form_n = F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less"))
    form = F.when(form_n.isNotNull(), F.col("best.other"))
    return met.select("word", "n", "n_near", form.alias("form"), form_n.alias("form_n"))


def _roots(links: DataFrame, steps: int) -> DataFrame:
    """word and root of words that have a form, following at most `steps` forms; each round doubles what is followed."""
    roots = stored(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(ceil(log2(steps)) if steps > 1 else 0):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return roots


def variants(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 7, least_n: int = 2, ratio: int = 10
) -> DataFrame:
    """The words of a corpus with the spelling they are taken for: word, form, root (forms followed to the last, the word itself if
    it has none), n, n_near, form_n."""
    bound_batches(docs.sparkSession)
    counted = words_of(docs, id_col=id_col, text_col=text_col, least=least)
    words = stored(counted.filter(F.col("n") >= least_n), "words")
    near = stored(near_words(words, ratio), "near-words")
    links = near.filter(F.col("form").isNotNull())
    # n grows by the ratio with every step, which bounds their number.
    most = words.agg(F.max("n")).first()[0]
    steps = floor(log10(most / least_n) / log10(ratio)) + 1 if most else 0
    found = near.join(_roots(links, steps), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
