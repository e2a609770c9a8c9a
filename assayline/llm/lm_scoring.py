"""Language-model scores of texts, from an Elias-Fano trie of word n-grams.

Level 1 holds the training words: their 64-bit hashes as an Elias-Fano sequence, which makes a word's place its number, and
their counts. Level 2 holds the words that follow a context word: pointers (a monotone sequence) lead from each context to its
followers, and the followers' numbers, made ascending over all contexts by adding the context's place times the number of words, are
one more sequence; beside each stands its smoothed probability, quantised to 256 values. A bigram is found by the successor of
(place of its context, number of its word) in that sequence. Both levels are cut into files at ranges of their keys, written to
the shared folder by tasks, and memory-mapped by the tasks that score; only blocks that a batch of sorted queries needs are read,
and each different pair of a part of the texts is looked up once.

Model: P(w) = (c(w) + 1) / (N + V + 1); P(w | v) = (c(vw) - D) / c(v) + B(v) P(w) for bigrams that training has at least
min_count times, B(v) P(w) for others, where B(v) is the mass those leave. The word before the first is the end of a text.

Counts are summed up in the tasks before they are shuffled. By default every bigram of training is kept; with a larger min_count,
words that occur less often can't be in a kept bigram and take no part in level 2. Contexts are dealt to shards by their share of all tokens, and one that has more than a shard's share is split
by its followers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.elias_fano import Opened, encode, named, save, sequence
from assayline.llm.storage import shared_uri, stored

#: Stands for the end of a text; no word has a blank.
END = b" "
#: Texts that are looked up together: a shard's file is opened once for all of them.
PART_BYTES = 1 << 23
#: Words whose counts a task holds before it sends them to be summed up.
MEMO_WORDS = 1_000_000
FLUSH_PAIRS = 1 << 21
LEVEL_ROWS = 500_000
SHARD_TOKENS = 2_000_000
MOST_SHARDS = 20_000


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """Ids, texts with A-Z lowered, and learn flags of bounded parts of the batches."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        starts = np.flatnonzero(np.diff(sizes // PART_BYTES, prepend=-1)).tolist()
        for start, stop in zip(starts, [*starts[1:], len(sizes)], strict=True):
            part = batch.slice(start, stop - start)
            yield part.column("id"), pc.ascii_lower(part.column("text")), part.column("learn")


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the different tokens, the end's first; the numbers among them of all tokens of the texts, each text closed by
    the end; the number of tokens of each text."""
    # White space of ASCII is \x20 and \x09-\x0D. A text without a word is split to an empty one.
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    coded = split.flatten().dictionary_encode()
    different = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.array([xxhash.xxh64_intdigest(END), *map(xxhash.xxh64_intdigest, different)], np.uint64)
    words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    if b"" in different:
        words = words[words != different.index(b"") + 1]
        sizes[pc.equal(pc.list_element(split, 0), "").to_numpy(zero_copy_only=False)] = 0
    sizes += 1
    found = np.zeros(len(words) + len(sizes), np.int64)
    inside = np.ones(len(found), bool)
    inside[np.cumsum(sizes) - 1] = False
    found[inside] = words
    return hashes, found, sizes


@dataclass
class Level1:
    """Files of level 1 in the order of their hashes. least: first hash; before: number of words in the files before."""

    places: list[str]
    least: np.ndarray
    before: np.ndarray
    tokens: int
    words: int


class Vocabulary:
    """Numbers and counts of words by hash, from mapped files, each opened when it is asked for."""

    def __init__(self, level: Level1, files: Opened):
        self.level, self.files = level, files

    def _file(self, number: int) -> dict[str, np.ndarray]:
        return self.files.get(self.level.places[number])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1 if unknown) and count of each hash."""
        numbers, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        wanted = hashes[order]
        file = np.searchsorted(self.level.least, wanted, "right") - 1
        for f in np.unique(file[file >= 0]):
            lo, hi = np.searchsorted(file, [f, f + 1])
            arrays = self._file(f)
            held = sequence("hashes", arrays)
            for part, position, value in held.successors(wanted[lo:hi]):
                to = order[lo:hi][part]
                hit = (value == wanted[lo:hi][part]) & (position < held.length)
                numbers[to[hit]] = self.level.before[f] + position[hit]
                counts[to[hit]] = arrays["counts"][position[hit]]
        return numbers, counts

    def count_of(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of ascending numbers."""
        file = np.searchsorted(self.level.before, numbers, "right") - 1
        out = np.zeros(len(numbers), np.int64)
        for f in np.unique(file):
            lo, hi = np.searchsorted(file, [f, f + 1])
            out[lo:hi] = self._file(f)["counts"][numbers[lo:hi] - self.level.before[f]]
        return out


def count_words(rows: DataFrame) -> DataFrame:
    """hash and n of every word of the rows (id, text, learn) to learn from, ends included."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        totals: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            hashes, of = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_inverse=True)
            total = np.zeros(len(hashes), np.int64)
            np.add.at(total, of, np.concatenate([np.zeros(0, np.int64), *totals]))
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(total)], names=["hash", "n"])

        for _, texts, learn in _parts(batches):
            hashes, found, _ = _tokens(texts.filter(learn))
            total = np.bincount(found, minlength=len(hashes))
            held.append(hashes[total > 0])
            totals.append(total[total > 0])
            if sum(map(len, held)) > MEMO_WORDS:
                yield flush()
                held, totals = [], []
        yield flush()

    return rows.mapInArrow(counted, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def build_level_1(counts: DataFrame, folder: str) -> Level1:
    """Writes level 1 from hash and n. Hashes are unsigned; the files are ranges of them."""
    tokens, words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    files = max(1, -(-words // LEVEL_ROWS))
    # Hashes are uniform, so equal ranges of them (by their upper half, unsigned) are equal shares.
    number = F.shiftrightunsigned(F.shiftrightunsigned("hash", 32) * files, 32)

    def built(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        hashes = table.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        arrays = named("hashes", encode(hashes[order])) | {"counts": table.column("n").to_numpy()[order]}
        place = save(folder, "words", arrays)
        least = int(hashes.min().view(np.int64))
        return pa.table({"file": pa.array([key[0].as_py()], pa.int32()), "place": [place], "least": [least], "words": [len(hashes)]})

    dealt = counts.withColumn("file", number.cast("int"))
    done = dealt.groupBy("file").applyInArrow(built, "file int, place string, least long, words long")
    rows = sorted(stored(done, "level1").collect(), key=lambda r: r.file)
    sizes = np.array([r.words for r in rows], np.int64)
    least = np.array([r.least for r in rows], np.int64).view(np.uint64)
    return Level1([r.place for r in rows], least, np.cumsum(sizes) - sizes, tokens, words)


def shard_cuts(level: Level1, spark_rows: DataFrame) -> list[int]:
    """First keys (context number x words + follower number) of the shards of level 2, each of a like share of all tokens."""
    share = max(SHARD_TOKENS, level.tokens // MOST_SHARDS)
    words = level.words
    if words * words >= 1 << 63:
        raise ValueError(f"{words} different words: their pairs can't be numbered in 64 bits")
    sent = spark_rows.sparkSession.sparkContext.broadcast(level)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.column("id").to_pylist():
                with Opened() as files:
                    counts, before = np.array(files.get(sent.value.places[f])["counts"]), int(sent.value.before[f])
                whole = np.cumsum(counts) // share
                at = np.flatnonzero(np.diff(whole, prepend=0))
                cuts = []
                for i in at.tolist():
                    pieces = max(1, int(counts[i]) // share)
                    cuts += [(before + i) * words + j * words // pieces for j in range(pieces)]
                    cuts.append((before + i + 1) * words)
                yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.int64())], names=["cut"])

    files = spark_rows.sparkSession.range(len(level.places), numPartitions=max(1, len(level.places)))
    return sorted({0, *(r.cut for r in files.mapInArrow(cut, "cut long").collect())})


def count_pairs(rows: DataFrame, level: Level1, cuts: list[int], min_count: int) -> DataFrame:
    """Rows (shard, keys, counts): ascending pair keys of a task's part of the rows to learn from, as the bytes of int64 arrays
    of differences and of int32 arrays."""
    sent = rows.sparkSession.sparkContext.broadcast((level, np.array(cuts, np.int64)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bounds = sent.value
        waiting: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *waiting]), return_counts=True)
            edges = np.append(np.searchsorted(keys, bounds), len(keys))
            used = np.flatnonzero(np.diff(edges))
            spans = [slice(edges[s], edges[s + 1]) for s in used]
            gaps = [np.diff(keys[x], prepend=bounds[s]).astype(np.int64).tobytes() for s, x in zip(used, spans, strict=True)]
            sizes = [counts[x].astype(np.int32).tobytes() for x in spans]
            return pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(gaps, pa.binary()), pa.array(sizes, pa.binary())], names=["shard", "keys", "counts"]
            )

        with Opened() as files:
            vocabulary = Vocabulary(own, files)
            for _, texts, learn in _parts(batches):
                hashes, found, _ = _tokens(texts.filter(learn))
                number, count = vocabulary.find(hashes)
                numbers = np.where(count >= min_count, number, -1)
                ids = numbers[found]
                before = np.concatenate([numbers[:1], ids[:-1]])[: len(ids)]
                known = (ids >= 0) & (before >= 0)
                waiting.append(before[known] * own.words + ids[known])
                if sum(map(len, waiting)) > FLUSH_PAIRS:
                    yield flush()
                    waiting = []
        yield flush()

    return rows.mapInArrow(counted, "shard int, keys binary, counts binary")


def build_level_2(
    pairs: DataFrame, level: Level1, cuts: list[int], folder: str, min_count: int, discount: float
) -> list[str | None]:
    """Writes level 2, a file for each shard that has a kept bigram; the place of each, None for the others."""
    sent = pairs.sparkSession.sparkContext.broadcast((level, np.array(cuts, np.int64)))

    def built(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        own, bounds = sent.value
        shard = key[0].as_py()
        keys = np.concatenate([bounds[shard] + np.cumsum(np.frombuffer(x.as_buffer(), np.int64)) for x in table.column("keys")])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in table.column("counts")]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        begins = np.flatnonzero(np.diff(keys[order], prepend=-1))
        keys, counts = keys[order][begins], np.add.reduceat(counts[order], begins)
        kept = counts >= min_count
        keys, counts = keys[kept], counts[kept]
        if not len(keys):
            return pa.table({"shard": pa.array([], pa.int32()), "place": pa.array([], pa.string())})
        context, follower = np.divmod(keys, own.words)
        contexts, starts, place = np.unique(context, return_index=True, return_inverse=True)
        with Opened() as files:
            total = Vocabulary(own, files).count_of(contexts)
        share = (counts - discount) / total[place]
        # 256 values in equal steps of the logarithm, so that no bigram is further off than half a step, however rare its share is.
        logs = np.log10(share)
        levels = np.linspace(logs.min(), logs.max(), 256).astype(np.float32)
        middle = (levels[1:] + levels[:-1]) / 2
        arrays = (
            named("contexts", encode(contexts))
            | named("pointers", encode(np.append(starts, len(keys))))
            | named("followers", encode(place * own.words + follower))
            | {"mass": np.add.reduceat(share, starts).astype(np.float32)}
            | {"share": np.searchsorted(middle, logs).astype(np.uint8), "levels": levels}
        )
        return pa.table({"shard": pa.array([shard], pa.int32()), "place": [save(folder, "pairs", arrays)]})

    done = pairs.groupBy("shard").applyInArrow(built, "shard int, place string")
    places: list[str | None] = [None] * len(cuts)
    for r in stored(done, "level2").collect():
        places[r.shard] = r.place
    return places


class Followers:
    """One file of level 2."""

    def __init__(self, arrays: dict[str, np.ndarray], words: int):
        self.words = words
        self.contexts, self.pointers = sequence("contexts", arrays), sequence("pointers", arrays)
        self.followers = sequence("followers", arrays)
        self.mass, self.share, self.levels = arrays["mass"], arrays["share"], np.asarray(arrays["levels"])

    def find(self, context: np.ndarray, follower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For bigrams in ascending order: the discounted share (0 if not kept), and distinct contexts with their kept mass."""
        distinct, of = np.unique(context, return_inverse=True)
        place = np.full(len(distinct), -1, np.int64)
        for part, position, value in self.contexts.successors(distinct.astype(np.uint64)):
            hit = (position < self.contexts.length) & (value == distinct[part].astype(np.uint64))
            place[part] = np.where(hit, position, -1)
        there = place >= 0
        mass = np.zeros(len(distinct))
        mass[there] = self.mass[place[there]]
        begin, end = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        begin[there] = self.pointers.at(place[there])
        end[there] = self.pointers.at(place[there] + 1)
        share = np.zeros(len(context))
        asked = np.flatnonzero(place[of] >= 0)
        wanted = (place[of][asked] * self.words + follower[asked]).astype(np.uint64)
        for part, position, value in self.followers.successors(wanted):
            to = asked[part]
            hit = (position >= begin[of[to]]) & (position < end[of[to]]) & (value == wanted[part])
            share[to[hit]] = 10.0 ** self.levels[self.share[position[hit]]]
        return share, distinct, mass


def score_rows(rows: DataFrame, level: Level1, cuts: list[int], places: list[str | None]) -> DataFrame:
    """id, n_tokens, n_known, base_score, score of the rows (id, text, learn)."""
    sent = rows.sparkSession.sparkContext.broadcast((level, np.array(cuts, np.int64), places))
    fields = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double"}
    schema = rows.select("id", *[F.lit(0).cast(t).alias(n) for n, t in fields.items()]).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bounds, names = sent.value
        with Opened() as word_files, Opened() as pair_files:
            vocabulary = Vocabulary(own, word_files)

            def shard_file(shard: int) -> Followers:
                return Followers(pair_files.get(names[shard]), own.words)

            for ids, texts, _ in _parts(batches):
                hashes, found, sizes = _tokens(texts)
                number, count = vocabulary.find(hashes)
                # Tokens in the order of their numbers, unknown ones first, so that pairs of them are in that of the shards.
                by = np.argsort(number, kind="stable")
                rank = np.empty(len(by), np.int64)
                rank[by] = np.arange(len(by))
                numbers, counts, found, end = number[by], count[by], rank[found], rank[0]
                plain = (counts + 1) / (own.tokens + own.words + 1)
                starts = np.cumsum(sizes) - sizes
                before = np.concatenate([[end], found[:-1]])
                before[starts] = end
                # Each different pair is looked up once.
                pairs, which = np.unique(before * len(by) + found, return_inverse=True)
                context, token = np.divmod(pairs, len(by))
                chance = plain[token]
                known = int(np.searchsorted(context, np.searchsorted(numbers, 0)))
                chance[known:] = _pair_chances(
                    chance[known:], numbers[context[known:]], numbers[token[known:]], own.words, bounds, names, shard_file
                )
                arrays = [
                    sizes,
                    np.add.reduceat((counts > 0)[found], starts, dtype=np.int64),
                    np.add.reduceat(np.log10(plain)[found], starts),
                    np.add.reduceat(np.log10(chance)[which], starts),
                ]
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, arrays)], names=["id", *fields])

    return rows.mapInArrow(scored, schema)


def _pair_chances(
    plain: np.ndarray,
    context: np.ndarray,
    token: np.ndarray,
    words: int,
    bounds: np.ndarray,
    names: list[str | None],
    shard_file: Callable[[int], Followers],
) -> np.ndarray:
    """Probabilities of tokens (-1 if unknown) behind known contexts, in ascending order of both. A context may be split over shards:
    each of them adds its part of the mass, the shard of the pair itself the share."""
    contexts, of = np.unique(context, return_inverse=True)
    mass = np.zeros(len(contexts))
    pairs = context * words + np.maximum(token, 0)
    share = np.zeros(len(pairs))
    shard = np.searchsorted(bounds, pairs, "right") - 1
    for s in np.unique(shard).tolist():
        if names[s] is not None:
            lo, hi = np.searchsorted(shard, [s, s + 1])
            share[lo:hi], distinct, part = shard_file(s).find(*np.divmod(pairs[lo:hi], words))
            mass[np.searchsorted(contexts, distinct)] += part
    # The parts of a split context's mass in shards to which none of its pairs led.
    first = np.searchsorted(bounds, contexts * words, "right") - 1
    last = np.searchsorted(bounds, contexts * words + words - 1, "right") - 1
    for i in np.flatnonzero(last > first).tolist():
        lo, hi = np.searchsorted(pairs, [contexts[i] * words, (contexts[i] + 1) * words])
        for s in sorted({*range(first[i], last[i] + 1)} - {*shard[lo:hi].tolist()}):
            if names[s] is not None:
                mass[i] += shard_file(s).find(contexts[i : i + 1], np.zeros(1, np.int64))[2][0]
    return np.where(token >= 0, share, 0.0) + (1.0 - mass[of]) * plain


def score_texts(
    docs: DataFrame,
    learn: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_count: int = 1,
    discount: float = 0.75,
) -> DataFrame:
    """Learns from the rows for which learn holds and scores all whole texts.

    Returns id_col, n_tokens, n_known, train_tokens, base_score and score, a row per row of docs: a null or empty text is its end
    alone; repeated rows and null ids are kept (repeated ones to learn from count each time); a null condition is false; other
    columns are left out. With nothing to learn from every token has probability 1.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn")
    )
    folder = shared_uri(docs.sparkSession)
    level = build_level_1(stored(count_words(rows), "words"), folder)
    cuts = shard_cuts(level, docs)
    places = build_level_2(count_pairs(rows, level, cuts, min_count), level, cuts, folder, min_count, discount)
    scored = score_rows(rows, level, cuts, places)
    return scored.select(
        F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(level.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
