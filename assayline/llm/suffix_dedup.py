"""Removal of repeated passages by suffix arrays.

A byte goes if a string of `length` bytes covers it that also starts in a document with a smaller id. All texts together are
far too large for one suffix array, so that shards are cut in which all equal strings meet:

1. Anchors. Of all 16-byte strings inside a window of `length` bytes the one with the least hash is the window's anchor: equal
   windows have equal anchors. Windows side by side with one anchor form a segment. Tasks sum up the documents of each anchor, shards
   find the anchors that several documents have, and write them as Elias-Fano sequences to the shared folder.
2. Segments. Tasks look up their anchors there; segments of shared anchors are collected, each different one once with
   the least and the greatest document that has it.
3. Suffix arrays. In each shard of anchors, a window of a segment first starts in the segment's least document, or in one of another
   segment of the same anchor. Segments that agree with another one in 16 bytes and the longer side around the anchor are joined
   to one text, whose suffixes are sorted externally (induced_sort); in runs of suffixes with `length` bytes in common, all windows
   first start in the least document of the run. What each segment's windows have is written to the shared folder by segment.
4. Removal. Tasks look up the segments of their documents and cut out all windows that first start in a smaller document.

The files of neighbouring shards are merged before they are looked up, so that a part of the texts does not look into a file of each
shard. Texts are read three times and never shuffled whole. An anchor with very many different segments (copies with edits everywhere)
is not sent to one shard; its windows are grouped by Spark one by one, with partial sums.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.elias_fano import Opened, _ranges, encode, named, save, sequence
from assayline.llm.induced_sort import sort_suffixes
from assayline.llm.storage import bound_batches, release_shuffles, shared_uri, stored

ANCHOR = 16
#: Texts that are hashed together (fit a processor's cache), and texts that are looked up together.
CHUNK_BYTES = 1 << 18
PART_BYTES = 1 << 22
SHARD_BYTES = 1 << 23
#: Shards next to each other whose results are merged to one file: a part of the texts asks all files, and so not all shards.
FILE_SHARDS = 64
#: Anchors that a task collects before it sends them to their shards.
HELD_ANCHORS = 1 << 18
HOT_SEGMENTS = 20_000
#: Segments that are joined to one text for a suffix array; those of one anchor stay together.
TEXT_BYTES = 1 << 20
#: Order of rows without id: after all others.
LAST = (1 << 63) - 1


@dataclass
class Segments:
    """Of joined texts: first window, number of windows, anchor's hash, its place behind the first window, and document."""

    begin: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    at: np.ndarray
    document: np.ndarray


def find_segments(raw: bytes, ends: np.ndarray, length: int) -> Segments:
    """Segments of texts joined to one byte string; ends: the end of each text."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(starts // CHUNK_BYTES)) + 1).tolist(), len(ends)]
    found = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            one = _chunk_segments(raw[starts[a] : ends[b - 1]], ends[a:b] - starts[a], length)
            found.append(Segments(one.begin + starts[a], one.windows, one.anchor, one.at, one.document + a))
    if not found:
        return _chunk_segments(b"", np.zeros(0, np.int64), length)
    return Segments(*[np.concatenate([getattr(x, n) for x in found]) for n in ("begin", "windows", "anchor", "at", "document")])


def _chunk_segments(raw: bytes, ends: np.ndarray, length: int) -> Segments:
    size, span = len(raw), length - ANCHOR + 1
    starts = np.concatenate([[0], ends[:-1]])
    if size < length:
        none = np.zeros(0, np.int64)
        return Segments(none, none, np.zeros(0, np.uint64), none, none)
    padded = raw + bytes(2 * ANCHOR + 8)
    eight = np.empty(size + ANCHOR, np.uint64)
    for offset in range(8):
        part = eight[offset::8]
        part[:] = np.frombuffer(padded, np.uint64, len(part), offset)
    mark = (eight[:size] * np.uint64(0x9E3779B97F4A7C15)) ^ (eight[8 : size + 8] * np.uint64(0xC2B2AE3D27D4EB4F))
    mark ^= mark >> np.uint64(29)
    mark *= np.uint64(0xBF58476D1CE4E5B9)
    mark ^= mark >> np.uint64(32)
    # Least upper half of the hash, of equal ones the leftmost.
    least = (mark & np.uint64(0xFFFFFFFF00000000)) | np.arange(size, dtype=np.uint64)
    reach = 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: reach - span], least[span - reach :])
    least = least[: size - length + 1]
    inside = np.zeros(len(least) + 1, np.int32)
    has = ends - starts >= length
    np.add.at(inside, starts[has], 1)
    np.add.at(inside, ends[has] - length + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    edge = np.ones(len(least), bool)
    edge[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    begin = np.flatnonzero(edge & inside)
    stop = np.flatnonzero(np.append(edge[1:] | ~inside[1:], True) & inside) + 1
    place = (least[begin] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return Segments(begin, stop - begin, _spread(mark[place]), place - begin, np.searchsorted(ends, begin, "right"))


def _spread(mark: np.ndarray) -> np.ndarray:
    """Hashes that are spread evenly, one to one: those chosen as the least of many are small ones."""
    mark = mark * np.uint64(0xD6E8FEB86659FD93)
    mark ^= mark >> np.uint64(32)
    return mark * np.uint64(0xD6E8FEB86659FD93)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bytes, np.ndarray]]:
    """Parts of the batches of about PART_BYTES (a longer text alone): rows, joined texts, ends."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PART_BYTES, prepend=-1))
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(sizes)], strict=True):
            part = batch.slice(a, b - a)
            yield part, b"".join([x.as_buffer().to_pybytes() for x in part.column("text")]), np.cumsum(sizes[a:b])


def _shard_of(anchor: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the anchors' hashes."""
    return ((anchor >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def anchor_documents(rows: DataFrame, shards: int, length: int) -> DataFrame:
    """Rows (shard, anchors, least, greatest): of a task's part of the rows, the distinct ascending anchors with the least and
    greatest order of their documents, as the bytes of arrays."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        orders: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            anchors, order = np.concatenate(held), np.concatenate(orders)
            by = np.lexsort((order, anchors))
            anchors, order = anchors[by], order[by]
            begin = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
            stop = np.append(begin[1:], len(anchors)) - 1
            least, greatest, anchors = order[begin], order[stop], anchors[begin]
            runs = list(_by_shard(_shard_of(anchors, shards)))
            used, parts = [s for s, _, _ in runs], [slice(first, past) for _, first, past in runs]
            columns = [
                pa.array([np.diff(anchors[x], prepend=np.uint64(0)).tobytes() for x in parts], pa.binary()),
                pa.array([least[x].tobytes() for x in parts], pa.binary()),
                pa.array([(greatest[x] - least[x]).tobytes() for x in parts], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *columns], names=["shard", "anchors", "least", "more"])

        for part, raw, ends in _parts(batches):
            segments = find_segments(raw, ends, length)
            if len(segments.begin):
                held.append(segments.anchor)
                orders.append(part.column("rank").to_numpy()[segments.document])
            if sum(map(len, held)) > HELD_ANCHORS:
                yield flush()
                held, orders = [], []
        if held:
            yield flush()

    return rows.mapInArrow(found, "shard int, anchors binary, least binary, more binary")


def write_shared_anchors(found: DataFrame, folder: str) -> DataFrame:
    """Rows (shard, place): the anchors of several documents, as a sequence in the shared folder."""

    def written(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        anchors = np.concatenate([np.cumsum(np.frombuffer(x.as_buffer(), np.uint64)) for x in table.column("anchors")])
        least = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("least")])
        greatest = least + np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column("more")])
        by = np.argsort(anchors)
        anchors, least, greatest = anchors[by], least[by], greatest[by]
        begin = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
        shared = np.minimum.reduceat(least, begin) < np.maximum.reduceat(greatest, begin)
        anchors = anchors[begin][shared]
        places = [save(folder, "anchors", encode(anchors))] if len(anchors) else []
        return pa.table({"shard": pa.array([key[0].as_py()] * len(places), pa.int32()), "place": pa.array(places, pa.string())})

    return found.groupBy("shard").applyInArrow(written, "shard int, place string")


class _Files:
    """The files of all shards by their number, of which few are open at a time."""

    def __init__(self, places: dict[int, list[str]], opened: Opened):
        self.places, self.opened = places, opened

    def get(self, number: int) -> list[dict[str, np.ndarray]]:
        return [self.opened.get(p) for p in self.places.get(number, [])]


@contextmanager
def _files(places: dict[int, list[str]]) -> Iterator[_Files]:
    with Opened() as opened:
        yield _Files(places, opened)


def _file_of(anchor: np.ndarray, shards: int) -> np.ndarray:
    return _shard_of(anchor, shards) // FILE_SHARDS


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Shard or file, first and past of the runs of rising numbers: only those that occur."""
    used, begins = np.unique(shard, return_index=True)
    yield from zip(used.tolist(), begins.tolist(), np.append(begins, len(shard))[1:].tolist(), strict=True)


def _known(anchors: np.ndarray, files: _Files, shards: int) -> np.ndarray:
    """Which of the anchors several documents have."""
    wanted, of = np.unique(anchors, return_inverse=True)
    out = np.zeros(len(wanted), bool)
    for number, first, past in _by_shard(_file_of(wanted, shards)):
        for arrays in files.get(number):
            for part, _, value in _as_sequence(arrays).successors(wanted[first:past]):
                out[first:past][part] = value == wanted[first:past][part]
    return out[of]


def _as_sequence(arrays: dict[str, np.ndarray]):  # noqa: ANN202
    return sequence("", {f".{k}": v for k, v in arrays.items()})


def shared_segments(rows: DataFrame, places: dict[int, list[str]], shards: int, length: int) -> DataFrame:
    """Rows (shard, anchor, at, segment, least, greatest): each different segment of a shared anchor, with the anchor's place, its
    text, and the least and greatest order of its documents."""
    sent = rows.sparkSession.sparkContext.broadcast(places)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _files(sent.value) as files:
            for part, raw, ends in _parts(batches):
                segments = find_segments(raw, ends, length)
                kept = np.flatnonzero(_known(segments.anchor, files, shards))
                begin, stop = segments.begin[kept], segments.begin[kept] + segments.windows[kept] + length - 1
                order = part.column("rank").to_numpy()[segments.document[kept]]
                anchor, at = segments.anchor[kept], segments.at[kept].astype(np.int32)
                texts = [raw[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
                columns = [_shard_of(anchor, shards).astype(np.int32), anchor.view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), pa.array(at), pa.array(texts, pa.binary()), pa.array(order)],
                    names=["shard", "anchor", "at", "segment", "rank"],
                )

    every = rows.mapInArrow(found, "shard int, anchor long, at int, segment binary, rank long")
    return every.groupBy("shard", "anchor", "at", "segment").agg(F.min("rank").alias("least"), F.max("rank").alias("greatest"))


def _candidates(segments: list[bytes], at: np.ndarray, length: int) -> np.ndarray:
    """Places of segments that may share a window with another one of their anchor. A window has at least half of its other
    bytes on one side of the anchor, so two segments can share one only if they agree in the anchor and so many bytes there."""
    half = (length - ANCHOR + 1) // 2
    sides = np.zeros((len(segments), 2), np.int64)
    for i, (text, place) in enumerate(zip(segments, at.tolist(), strict=True)):
        before, behind = text[max(0, place - half) : place + ANCHOR], text[place : place + ANCHOR + half]
        sides[i, 0] = xxhash.xxh64_intdigest(before) >> 1 if place >= half else -1 - i
        sides[i, 1] = xxhash.xxh64_intdigest(behind, 1) >> 1 if len(behind) == ANCHOR + half else -1 - i
    chosen = np.zeros(len(segments), bool)
    for side in sides.T:
        _, of, times = np.unique(side, return_inverse=True, return_counts=True)
        chosen |= (times[of] > 1) & (side >= 0)
    return np.flatnonzero(chosen)


def first_starts(segments: list[bytes], least: np.ndarray, length: int, folder: str) -> list[np.ndarray]:
    """For each segment the order of the document in which each of its windows first starts, from the segments' suffix array."""
    sizes = np.array([len(x) for x in segments], np.int64)
    if not len(sizes):
        return []
    begins = np.cumsum(sizes + 1) - sizes - 1
    # Symbols: 0 ends the text, 1 stands behind each segment, bytes are raised by 2.
    text = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.uint16)
    text[:-1] = 1
    inside = np.ones(len(text), bool)
    inside[begins + sizes] = inside[-1] = False
    text[inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint16) + 2
    order, common = sort_suffixes(text, length, folder)
    owner = np.searchsorted(begins, order, "right") - 1
    window = order <= begins[owner] + sizes[owner] - length
    run = np.cumsum(np.asarray(common) < length)[window]
    owner, at = owner[window], np.asarray(order)[window]
    edges = np.flatnonzero(np.diff(run, prepend=-1))
    first = np.minimum.reduceat(least[owner], edges)
    by_place = np.full(len(text), -1, np.int64)
    by_place[at] = np.repeat(first, np.diff(np.append(edges, len(run))))
    return [by_place[a : a + n - length + 1] for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)]


def _write_starts(segments: list[bytes], firsts: list[int | np.ndarray], folder: str) -> str:
    """Writes for each segment the runs of its windows with one first document (a number if all have the same); segments by
    hash."""
    marks = np.array([xxhash.xxh64_intdigest(x) for x in segments], np.uint64)
    by = np.argsort(marks).tolist()
    whole = np.zeros(1, np.int64)
    edges = [whole if isinstance(x := firsts[i], int) else np.flatnonzero(np.diff(x, prepend=x[0] - 1)) for i in by]
    counts = np.array([len(x) for x in edges], np.int64)
    arrays = named("segments", encode(marks[by])) | named("pointers", encode(np.concatenate([[0], np.cumsum(counts)])))
    arrays["from"] = np.concatenate(edges).astype(np.uint16)
    values = [[x] if isinstance(x := firsts[i], int) else x[e] for i, e in zip(by, edges, strict=True)]
    arrays["first"] = np.concatenate(values).astype(np.int64)
    return save(folder, "starts", arrays)


def _by_size(chosen: np.ndarray, anchor: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    """Cuts segments in the order of their anchors into parts of about TEXT_BYTES, between anchors only."""
    if len(chosen):
        first = np.flatnonzero(np.append(True, anchor[chosen][1:] != anchor[chosen][:-1]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(chosen))))
        number = ((np.cumsum(sizes) - sizes) // TEXT_BYTES)[first][group]
        yield from np.split(chosen, np.flatnonzero(np.diff(number)) + 1)


def write_first_starts(distinct: DataFrame, folder: str, length: int) -> DataFrame:
    """Rows (shard, place): first documents of the windows of each segment, from the suffix arrays of the shards."""

    def written(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        segments = table.column("segment").to_pylist()
        anchor, least = table.column("anchor").to_numpy(), table.column("least").to_numpy()
        greatest = table.column("greatest").to_numpy()
        firsts: list[int | np.ndarray] = least.tolist()
        _, of, times = np.unique(anchor, return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(times[of] > 1)
        mixed = mixed[_candidates([segments[i] for i in mixed], table.column("at").to_numpy()[mixed], length)]
        mixed = mixed[np.argsort(anchor[mixed], kind="stable")]
        for some in _by_size(mixed, anchor, [len(segments[i]) for i in mixed]):
            with tempfile.TemporaryDirectory() as own:
                found = first_starts([segments[i] for i in some], least[some], length, own)
            for i, x in zip(some.tolist(), found, strict=True):
                firsts[i] = x
        useful = [i for i, x in enumerate(firsts) if (x if isinstance(x, int) else x.min()) < greatest[i]]
        places = [_write_starts([segments[i] for i in useful], [firsts[i] for i in useful], folder)] if useful else []
        return pa.table({"shard": pa.array([key[0].as_py()] * len(places), pa.int32()), "place": pa.array(places, pa.string())})

    return distinct.groupBy("shard").applyInArrow(written, "shard int, place string")


def write_hot_starts(distinct: DataFrame, folder: str, length: int) -> DataFrame:
    """As write_first_starts, for anchors with very many segments: windows are grouped by Spark, and meet by segment again."""
    numbered = distinct.select("shard", "segment", "least", "greatest").withColumn(
        "number", F.explode(F.sequence(F.lit(1), F.octet_length("segment") - (length - 1)))
    )
    windows = numbered.withColumn("window", F.expr(f"substring(segment, number, {length})"))
    starts = windows.groupBy("window").agg(F.min("least").alias("first"))
    # Spark takes the windows to be as few as the segments they are exploded from, and would broadcast them.
    joined = windows.drop("least").hint("merge").join(starts, "window").groupBy("shard", "segment").agg(
        F.first("greatest").alias("greatest"), F.sort_array(F.collect_list(F.struct("number", "first"))).alias("firsts")
    )
    # A segment's windows have one anchor, so that a segment has at most length - ANCHOR + 1 of them.
    useful = joined.filter(F.array_min("firsts.first") < F.col("greatest"))
    dealt = useful.select("shard", "segment", F.col("firsts.first").alias("firsts"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("segment"), F.lit(16)))

    def written(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        firsts = [np.array(x, np.int64) for x in table.column("firsts").to_pylist()]
        place = _write_starts(table.column("segment").to_pylist(), firsts, folder)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "place": [place]})

    return dealt.groupBy("shard", "part").applyInArrow(written, "shard int, place string")


def _covered(
    raw: bytes, segments: Segments, order: np.ndarray, known: np.ndarray, files: _Files, shards: int, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of all runs of windows of the part that first start in a smaller document."""
    kept = np.flatnonzero(known)
    begin, windows, own = segments.begin[kept], segments.windows[kept], order[segments.document[kept]]
    ends = begin + windows + length - 1
    marks = np.array([xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)], np.uint64)
    number = _file_of(segments.anchor[kept], shards)
    by = np.lexsort((marks, number))
    froms, tos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, first, past in _by_shard(number[by]):
        mine = by[first:past]
        wanted, of = np.unique(marks[mine], return_inverse=True)
        for arrays in files.get(s):
            table, pointers = sequence("segments", arrays), sequence("pointers", arrays)
            place = np.full(len(wanted), -1, np.int64)
            for part, position, value in table.successors(wanted):
                place[part] = np.where((value == wanted[part]) & (position < table.length), position, -1)
            there = np.flatnonzero(place >= 0)
            lo, hi = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
            lo[there], hi[there] = pointers.at(place[there]), pointers.at(place[there] + 1)
            counts = (hi - lo)[of]
            which = np.repeat(mine, counts)
            runs = np.arange(len(which)) + np.repeat(lo[of] - (np.cumsum(counts) - counts), counts)
            at = arrays["from"][runs].astype(np.int64)
            over = np.append(at[1:], 0)
            last = np.cumsum(counts)[counts > 0] - 1
            over[last] = windows[mine][counts > 0]
            smaller = arrays["first"][runs] < own[which]
            froms.append((begin[which] + at)[smaller])
            tos.append((begin[which] + over + length - 1)[smaller])
    return np.concatenate(froms), np.concatenate(tos)


def _whole_characters(data: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs without the parts of characters at their ends; runs that hold no whole character go."""
    first = np.append((data & 0xC0) != 0x80, True)
    for _ in range(3):  # a character has at most three bytes behind its first
        left = np.where(first[left], left, left + 1)
        right = np.where(first[right], right, right - 1)
    return left[left < right], right[left < right]


def cut_repeats(
    rows: DataFrame, anchors: dict[int, list[str]], starts: dict[int, list[str]], shards: int, length: int, whole_characters: bool
) -> DataFrame:
    """id, carried, spans and kept of the rows (id, carried, rank, text)."""
    sent = rows.sparkSession.sparkContext.broadcast((anchors, starts))
    fields = {"spans": "array<struct<begin: bigint, end: bigint>>", "kept": "binary"}
    schema = rows.select("id", "carried", *[F.lit(None).cast(t).alias(n) for n, t in fields.items()]).schema
    span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _files(sent.value[0]) as anchor_files, _files(sent.value[1]) as start_files:
            for part, raw, ends in _parts(batches):
                segments = find_segments(raw, ends, length)
                known = _known(segments.anchor, anchor_files, shards)
                froms, tos = _covered(raw, segments, part.column("rank").to_numpy(), known, start_files, shards, length)
                cover = np.zeros(len(raw) + 1, np.int32)
                np.add.at(cover, froms, 1)
                np.add.at(cover, tos, -1)
                gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                # A run begins or ends where removal does, and ends with its document.
                border = np.zeros(len(raw) + 1, bool)
                border[begins] = border[len(raw)] = True
                border[1:-1] |= gone[1:] != gone[:-1]
                border = np.flatnonzero(border)
                left, right = border[:-1], border[1:]
                left, right = left[gone[left]], right[gone[left]]
                data = np.frombuffer(raw, np.uint8)
                if whole_characters:
                    left, right = _whole_characters(data, left, right)
                    cover = np.zeros(len(raw) + 1, np.int8)
                    cover[left] += 1
                    cover[right] -= 1
                    gone = np.cumsum(cover[:-1], dtype=np.int8) > 0
                owner = np.searchsorted(ends, left, "right")
                spans: list[list[dict[str, int]]] = [[] for _ in begins]
                for a, b, d in zip(left.tolist(), right.tolist(), owner.tolist(), strict=True):
                    spans[d].append({"begin": a - int(begins[d]), "end": b - int(begins[d])})
                keep = ~gone
                kept = [data[a:b][keep[a:b]].tobytes() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("carried"), pa.array(spans, span_type), pa.array(kept, pa.binary())],
                    names=["id", "carried", "spans", "kept"],
                )

    return rows.mapInArrow(cut, schema)


Arrays = dict[str, np.ndarray]


def merged_anchors(parts: list[Arrays]) -> Arrays:
    """The sequences of shards in their order, which is that of the anchors, as one."""
    return encode(np.concatenate([_as_sequence(x).values() for x in parts]))


def merged_starts(parts: list[Arrays]) -> Arrays:
    """What is written of the segments of several shards, by hash as before."""
    marks = np.concatenate([sequence("segments", x).values() for x in parts])
    counts = np.concatenate([np.diff(sequence("pointers", x).values().astype(np.int64)) for x in parts])
    by = np.argsort(marks, kind="stable")
    runs = _ranges((np.cumsum(counts) - counts)[by], counts[by])
    arrays = named("segments", encode(marks[by])) | named("pointers", encode(np.concatenate([[0], np.cumsum(counts[by])])))
    return arrays | {k: np.concatenate([x[k] for x in parts])[runs] for k in ("from", "first")}


def _places(done: list[DataFrame], name: str, merge: Callable[[list[Arrays]], Arrays], folder: str) -> dict[int, list[str]]:
    """Places by file number, of rows (shard, place). The files of FILE_SHARDS shards, of which there is one if few of them have
    any, are merged to one by a task."""
    out: dict[int, list[str]] = {}
    for r in sorted((r for x in done for r in stored(x, name).collect()), key=lambda r: (r.shard, r.place)):
        out.setdefault(r.shard // FILE_SHARDS, []).append(r.place)
    several = [(number, places) for number, places in out.items() if len(places) > 1]
    if not several:
        return out

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, places in zip(batch.column("number").to_pylist(), batch.column("places").to_pylist(), strict=True):
                with Opened() as opened:
                    place = save(folder, name, merge([opened.get(x) for x in places]))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([place])], names=["number", "place"])

    # As many tasks as files: rows this few would all be dealt to one.
    rows = done[0].sparkSession.createDataFrame(several, "number int, places array<string>").repartition(len(several))
    for r in stored(rows.mapInArrow(one, "number int, place string"), f"{name}-merged").collect():
        out[r.number] = [r.place]
    return out


def remove_repeats(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    length: int = 50,
    whole_characters: bool = False,
    shard_bytes: int = SHARD_BYTES,
    hot_segments: int = HOT_SEGMENTS,
) -> DataFrame:
    """Whole texts as UTF-8 bytes without what a document of a smaller id has too.

    Returns id_col, the columns to carry, n_bytes, spans (the maximal removed runs: begin and end in bytes) and kept (the other
    bytes, joined), a row per row of docs. With whole_characters, runs end at characters, so that kept is UTF-8. Matches lie
    inside one document each, and are judged on the input. A null text is empty; texts shorter
    than length stay whole; rows of one id do not remove each other's text; a null id counts as larger than all others; other
    columns are left out; an empty table gives an empty one. length is from 31 to 65,000 bytes.
    """
    if not 2 * ANCHOR - 1 <= length <= 65_000:
        raise ValueError("length must be from 31 to 65,000")
    bound_batches(docs.sparkSession)
    folder = shared_uri(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("rank"),
        text.alias("text"),
        F.struct(F.lit(True).alias("_"), *carry).alias("carried"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    texts = rows.select("rank", "text")
    anchors = _places([write_shared_anchors(anchor_documents(texts, shards, length), folder)], "anchors-of", merged_anchors, folder)
    large = total > SHARD_BYTES
    if large:
        release_shuffles(docs.sparkSession)
    distinct = stored(shared_segments(texts, anchors, shards, length), "segments")
    if large:
        release_shuffles(docs.sparkSession)
    # Few rows, one for each hot anchor; Spark knows the stored table's size.
    hot = stored(distinct.groupBy("anchor").count().filter(F.col("count") > hot_segments).select("anchor"), "hot")
    done = [write_first_starts(distinct.join(hot, "anchor", "left_anti"), folder, length)]
    if not hot.isEmpty():
        done.append(write_hot_starts(distinct.join(hot, "anchor", "left_semi"), folder, length))
    starts = _places(done, "starts-of", merged_starts, folder)
    found = cut_repeats(rows, anchors, starts, shards, length, whole_characters)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        F.col("id").alias(id_col),
        *[F.col("carried")[c].alias(c) for c in carry],
        (F.octet_length("kept") + gone).cast("long").alias("n_bytes"),
        "spans",
        "kept",
    )
