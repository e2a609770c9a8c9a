"""Elias-Fano sequences in memory-mapped files.

A value of an ascending sequence is cut in two. The low parts lie side by side in whole bytes; the high parts are unary: a one
for each value, after as many zeros as the high part grows. Every BLOCK values the place in the unary bits is noted, so that
any set of blocks is decoded alone. Values are counted from the first.
"""

from __future__ import annotations

import json
import math
import mmap
import shutil
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

BLOCK = 16
BLOCKS_AT_ONCE = 1 << 15
#: Files that a task has open at a time, and where arrays begin in a file.
OPEN_FILES = 64
ALIGNED = 64


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of an ascending sequence of uint64, to be stored and given to Sequence."""
    values = values.astype(np.uint64)
    start = values[:1]
    rest = values - start[0] if len(values) else values
    spread = int(rest[-1]) // len(rest) if len(rest) else 0
    planes = (spread.bit_length() + 7) // 8 if spread > 1 else 0
    low = [((rest >> np.uint64(8 * i)) & np.uint64(255)).astype(np.uint8) for i in range(planes)]
    high = (rest >> np.uint64(8 * planes)).astype(np.int64) if planes < 8 else np.zeros(len(rest), np.int64)
    places = high + np.arange(len(high))
    bits = np.zeros(int(places[-1]) + 1 if len(places) else 0, bool)
    bits[places] = True
    marks = np.append(places[::BLOCK], len(bits))
    return {
        "start": start,
        "low": np.stack(low) if low else np.zeros((0, len(values)), np.uint8),
        "high": np.packbits(bits, bitorder="little"),
        "marks": marks.astype(np.int64),
        "first": values[::BLOCK],
        "length": np.array([len(values)], np.int64),
    }


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as each length, in one array."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Sequence:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.start, self.low, self.high = arrays["start"], arrays["low"], arrays["high"]
        self.marks, self.first = np.asarray(arrays["marks"]), np.asarray(arrays["first"])
        self.length = int(arrays["length"][0])

    def decode(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and values of the given ascending blocks."""
        sizes = np.minimum(self.length - blocks * BLOCK, BLOCK)
        at = _ranges(blocks * BLOCK, sizes)
        from_, to = self.marks[blocks], self.marks[blocks + 1]
        places = _ranges(from_, to - from_)
        ones = (self.high[places >> 3] >> (places & 7).astype(np.uint8)) & 1
        high = places[ones.astype(bool)] - at
        values = high.astype(np.uint64) << np.uint64(8 * len(self.low)) if len(self.low) < 8 else np.zeros(len(at), np.uint64)
        for i, plane in enumerate(self.low):
            values |= plane[at].astype(np.uint64) << np.uint64(8 * i)
        return at, values + self.start[0]

    def successors(self, wanted: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """For ascending wanted values, part by part: the part, and position and value of the first element that is not less
        (position length and value 0 if there is none). Only blocks that can hold one are decoded."""
        if not self.length:
            yield slice(0, len(wanted)), np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.uint64)
            return
        block = np.maximum(np.searchsorted(self.first, wanted, "left") - 1, 0)
        distinct, begins = np.unique(block, return_index=True)
        for i in range(0, len(distinct), BLOCKS_AT_ONCE):
            chosen = distinct[i : i + BLOCKS_AT_ONCE]
            stop = begins[i + BLOCKS_AT_ONCE] if i + BLOCKS_AT_ONCE < len(begins) else len(wanted)
            part = slice(int(begins[i]), int(stop))
            at, values = self.decode(chosen)
            # Behind a block the next element is the first of the next block.
            found = np.searchsorted(values, wanted[part], "left")
            last = np.searchsorted(chosen, block[part])
            end = np.cumsum(np.minimum(self.length - chosen * BLOCK, BLOCK))[last]
            beyond = found >= end
            position = np.where(beyond, (block[part] + 1) * BLOCK, at[np.minimum(found, len(at) - 1)])
            position = np.minimum(position, self.length)
            following = np.append(self.first, np.uint64(0))[np.minimum(block[part] + 1, len(self.first))]
            value = np.where(beyond, following, values[np.minimum(found, len(values) - 1)])
            yield part, position, np.where(position < self.length, value, np.uint64(0))

    def values(self) -> np.ndarray:
        """All values."""
        blocks = np.arange(len(self.first))
        parts = [self.decode(blocks[i : i + BLOCKS_AT_ONCE])[1] for i in range(0, len(blocks), BLOCKS_AT_ONCE)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def at(self, positions: np.ndarray) -> np.ndarray:
        """Values at ascending positions."""
        out = np.zeros(len(positions), np.uint64)
        block = positions // BLOCK
        distinct, begins = np.unique(block, return_index=True)
        for i in range(0, len(distinct), BLOCKS_AT_ONCE):
            chosen = distinct[i : i + BLOCKS_AT_ONCE]
            stop = begins[i + BLOCKS_AT_ONCE] if i + BLOCKS_AT_ONCE < len(begins) else len(positions)
            part = slice(int(begins[i]), int(stop))
            at, values = self.decode(chosen)
            out[part] = values[np.searchsorted(at, positions[part])]
        return out


def _system(place: str) -> tuple[fs.FileSystem, str]:
    if place.startswith("file:"):
        return fs.LocalFileSystem(), "/" + place.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes arrays as one new file in a shared folder, given as URI or path; its place. A task that runs twice leaves two whole
    files, of which the caller knows one."""
    place = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    header, at = {}, 0
    for key, array in arrays.items():
        header[key] = (array.dtype.str, array.shape, at)
        at += -(-array.nbytes // ALIGNED) * ALIGNED
    head = json.dumps(header).encode()
    head += b" " * (-(len(head) + 8) % ALIGNED)
    target, path = _system(place)
    target.create_dir(path.rpartition("/")[0], recursive=True)
    with target.open_output_stream(path) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for array in arrays.values():
            out.write(np.ascontiguousarray(array).tobytes())
            out.write(b"\0" * (-array.nbytes % ALIGNED))
    return place


class Opened:
    """Saved arrays by place, memory-mapped when asked for. At most `limit` files are open at a time, whatever their number: the one not
    used for longest is closed. Files that are not on a mounted file system are copied to the task's own folder, once."""

    def __init__(self, limit: int | None = None):
        self.limit = OPEN_FILES if limit is None else limit
        self.held: OrderedDict[str, dict[str, np.ndarray]] = OrderedDict()
        self.copies: dict[str, str] = {}
        self.own: str | None = None

    def __enter__(self) -> Opened:
        return self

    def __exit__(self, *_: object) -> None:
        self.held.clear()
        if self.own:
            shutil.rmtree(self.own, ignore_errors=True)

    def _path(self, place: str) -> str:
        target, path = _system(place)
        if isinstance(target, fs.LocalFileSystem):
            return path
        if place not in self.copies:
            self.own = self.own or tempfile.mkdtemp()
            self.copies[place] = f"{self.own}/{len(self.copies)}"
            fs.copy_files(path, self.copies[place], source_filesystem=target)
        return self.copies[place]

    def get(self, place: str) -> dict[str, np.ndarray]:
        if place in self.held:
            self.held.move_to_end(place)
            return self.held[place]
        while len(self.held) >= self.limit:
            self.held.popitem(last=False)
        with open(self._path(place), "rb") as file:
            data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        begin = 8 + int.from_bytes(data[:8], "little")
        arrays = {}
        for key, (kind, shape, at) in json.loads(data[8:begin]).items():
            size = math.prod(shape)
            arrays[key] = (np.frombuffer(data, kind, size, begin + at) if size else np.zeros(0, kind)).reshape(shape)
        self.held[place] = arrays
        return arrays


def named(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in arrays.items()}


def sequence(prefix: str, arrays: dict[str, np.ndarray]) -> Sequence:
    return Sequence({k.removeprefix(f"{prefix}."): v for k, v in arrays.items() if k.startswith(f"{prefix}.")})
