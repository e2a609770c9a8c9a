"""External induced sorting of the suffixes of a text, with common-prefix lengths up to a depth.

Suffixes smaller than their successor are S, the others L. The leftmost S suffixes of each run are sorted first: the text between
them is named by its rank, and the string of names, at most half as long, is sorted the same way in recursion, or by prefix
doubling where its names are too many for a queue each. From them all L suffixes are induced in ascending order and from those all
S suffixes in descending order: whenever a suffix is taken, the one before it, if it is of the type wanted, enters the queue
of its first symbol. A queue gets its entries in the order of their successors, so that a queue per symbol is a priority queue
whose pop is a read from the front; entries are (position, place of the successor in the order), and a queue that outgrows
its memory continues in a file. The common prefix of neighbours in a queue is one more than the least common prefix between their
successors, which the order found so far gives; only lengths up to the depth wanted are exact, and only so far the order is.

The text, the queues and the common-prefix lengths lie in files of the task's own folder; memory holds one queue at a time.
"""

from __future__ import annotations

import tempfile

import numpy as np

HELD_BYTES = 1 << 19
QUEUES = 4096
COMPARED_AT_ONCE = 1 << 14


class Queue:
    """Entries of two numbers, read once in the order they came; all but the last ones lie in a file."""

    def __init__(self, folder: str):
        self.folder = folder
        self.held: list[np.ndarray] = []
        self.bytes = 0
        self.file = None

    def push(self, position: np.ndarray, place: np.ndarray) -> None:
        entry = np.stack([position, place], 1)
        self.held.append(entry)
        self.bytes += entry.nbytes
        if self.bytes > HELD_BYTES:
            self.file = self.file or tempfile.TemporaryFile(dir=self.folder)
            for x in self.held:
                self.file.write(x.tobytes())
            self.held, self.bytes = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        parts = self.held
        if self.file:
            self.file.seek(0)
            parts = [np.fromfile(self.file, np.int64).reshape(-1, 2), *parts]
            self.file.close()
        self.held, self.file = [], None
        found = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
        return found[:, 0], found[:, 1]


def _file_array(folder: str, length: int, kind: type) -> np.ndarray:
    return np.memmap(tempfile.TemporaryFile(dir=folder), kind, "w+", shape=(max(1, length),))


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is S. The last symbol is less than all others, and S."""
    rises = text[1:] > text[:-1]
    decided = np.append(np.flatnonzero(text[1:] != text[:-1]), len(text) - 1)
    small = np.append(rises, True)[decided]
    # Equal symbols are of the type of the last of them.
    return np.repeat(small, np.diff(decided, prepend=-1))


def _names(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rank of the symbols from each start to the next one, which is part of them. Of two such that one begins the other, the
    shorter is the larger: it ends in an S symbol where the other has an L one."""
    width = 2 if text.dtype.itemsize <= 2 else 4
    raw = text.astype(f">u{width}").tobytes()
    ends = np.append(starts[1:] + 1, len(text)) * width
    above = b"\xff" * width
    parts = [raw[a:b] + above for a, b in zip((starts * width).tolist(), ends.tolist(), strict=True)]
    rank = {x: i for i, x in enumerate(sorted(set(parts)))}
    return np.fromiter(map(rank.__getitem__, parts), np.int64, len(parts))


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, exact up to depth names."""
    rank, covered = names, 1
    while covered < depth and int(rank.max(initial=0)) + 1 < len(rank):
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-covered] = rank[covered:] + 1
        _, rank = np.unique(rank * (len(rank) + 1) + ahead, return_inverse=True)
        covered *= 2
    return np.argsort(rank, kind="stable")


def _common(text: np.ndarray, one: np.ndarray, other: np.ndarray, depth: int) -> np.ndarray:
    """Common-prefix lengths of pairs of suffixes, up to depth."""
    out = np.zeros(len(one), np.int64)
    step = np.arange(depth)
    for i in range(0, len(one), COMPARED_AT_ONCE):
        part = slice(i, i + COMPARED_AT_ONCE)
        a, b = one[part, None] + step, other[part, None] + step
        last = len(text) - 1
        same = (text[np.minimum(a, last)] == text[np.minimum(b, last)]) & (np.maximum(a, b) <= last)
        out[part] = np.where(same.all(1), depth, same.argmin(1))
    return out


def _between(common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For neighbours in a queue: one more than the least common prefix between their successors' places."""
    if len(place) < 2:
        return np.zeros(0, np.int64)
    first = int(place[0]) + 1
    span = np.asarray(common[first : int(place[-1]) + 1])
    return 1 + np.minimum.reduceat(span, place[:-1] + 1 - first).astype(np.int64)


def _run_length(text: np.ndarray, position: int, depth: int) -> int:
    run = text[position : position + depth + 1] != text[position]
    return int(run.argmax()) if run.any() else len(run)


class _Induction:
    """One pass over the symbols. common: of each place in the order taken, the common prefix with the place before."""

    def __init__(self, text: np.ndarray, depth: int, folder: str, length: int):
        self.text, self.depth, self.folder = text, depth, folder
        self.queues: dict[int, Queue] = {}
        self.common = _file_array(folder, length, np.uint16)
        self.order = _file_array(folder, length, np.int64)
        self.taken = 0

    def take(self, positions: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Puts suffixes behind those taken; their places."""
        begin, self.taken = self.taken, self.taken + len(positions)
        self.order[begin : self.taken] = positions
        self.common[begin : self.taken] = np.minimum(common, self.depth)
        return np.arange(begin, self.taken)

    def push(self, positions: np.ndarray, places: np.ndarray, symbols: np.ndarray) -> None:
        if not len(symbols):
            return
        order = np.argsort(symbols, kind="stable")
        cuts = np.flatnonzero(np.diff(symbols[order], prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            chosen = order[a:b]
            queue = self.queues.setdefault(int(symbols[chosen[0]]), Queue(self.folder))
            queue.push(positions[chosen], places[chosen])

    def waves(self, symbol: int, ascending: bool) -> int:
        """Takes all that the symbol's queue holds, then those that this brings into it, and so on; the number of such waves.
        A suffix of the n-th wave begins with the symbol n times, and then goes on with one on the other side of it."""
        queue = self.queues.pop(symbol, None)
        if queue is None:
            return 0
        positions, places = queue.take()
        wave = 0
        while len(positions):
            places = self.take(positions, np.concatenate([[wave], _between(self.common, places)]))
            wave += 1
            before = positions - 1
            before, places = before[positions > 0], places[positions > 0]
            symbols = np.asarray(self.text[before]).astype(np.int64)
            other = symbols > symbol if ascending else symbols < symbol
            self.push(before[other], places[other], symbols[other])
            again = symbols == symbol
            positions, places = before[again], places[again]
        return wave

    def induce_from(self, positions: np.ndarray, places: np.ndarray, symbol: int, ascending: bool) -> None:
        """Pushes the suffixes before the given ones whose symbols lie beyond this symbol."""
        before = positions - 1
        before, places = before[positions > 0], places[positions > 0]
        symbols = np.asarray(self.text[before]).astype(np.int64)
        other = symbols > symbol if ascending else symbols < symbol
        self.push(before[other], places[other], symbols[other])


def sort_suffixes(text: np.ndarray, depth: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes but the last in descending order, and the common prefix of each with the one before it, both
    exact up to depth symbols.

    text is of unsigned integers; its last symbol must be 0 and occur nowhere else.
    """
    length = len(text)
    if length < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.uint16)
    small = _types(text)
    starts = np.flatnonzero(small[1:] & ~small[:-1]) + 1  # S behind L; the last symbol always is one
    names = _names(text, starts)
    symbols = int(names.max()) + 1
    if symbols == len(names):
        order = np.argsort(names)
    elif symbols <= QUEUES and len(names) > 1:
        reduced = names + 1  # the last name is the text's end alone, the least, and becomes the 0 of the reduced text
        reduced[-1] = 0
        descending, _ = sort_suffixes(reduced.astype(np.uint16), depth, folder)
        order = np.append(len(names) - 1, descending[::-1])
    else:
        order = _doubled(names, depth)
    seeds = starts[order]
    seed_common = np.concatenate([[0], _common(text, seeds[:-1], seeds[1:], depth)])
    seed_symbols = np.asarray(text[seeds]).astype(np.int64)

    up = _Induction(text, depth, folder, length)
    bounds: dict[int, tuple[int, int, int]] = {}  # of each symbol's L suffixes: first and last place, waves
    used = np.unique(text).astype(np.int64).tolist()
    for symbol in used:
        begin = up.taken
        waves = up.waves(symbol, ascending=True)
        bounds[symbol] = (begin, up.taken, waves)
        lo, hi = np.searchsorted(seed_symbols, [symbol, symbol + 1])
        if hi > lo:
            common = seed_common[lo:hi].copy()
            common[0] = min(waves, _run_length(text, int(seeds[lo]), depth)) if waves else 0
            places = up.take(seeds[lo:hi], common)
            up.induce_from(seeds[lo:hi], places, symbol, ascending=True)

    down = _Induction(text, depth, folder, length)
    for symbol in reversed(used):
        waves = down.waves(symbol, ascending=False)
        begin, end, own = bounds[symbol]
        if end > begin:
            positions = np.asarray(up.order[begin:end])[::-1]
            common = np.concatenate([[min(waves, own)], np.asarray(up.common[begin + 1 : end])[::-1].astype(np.int64)])
            places = down.take(positions, common)
            down.induce_from(positions, places, symbol, ascending=False)
    return down.order[: down.taken], down.common[: down.taken]
