"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

Distinct pre-tokens of a batch are put into matrices of similar length, a row each, padded with -1. In every round each row
merges its leftmost pair of minimum rank: pair ranks come from an open-addressing hash table over all pairs of tokens that
form a token, and after the merge the row is compacted by one place. Rows without a pair to merge leave the matrix.

Rows are independent: there is no shuffle, and a lost task is computed again. The rank file and the pair table are sent to
the executors; their size is that of the vocabulary.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.pretokens import CLASS_MARKS, Splitter
from assayline.llm.storage import Memo, bound_batches, release_memory

NO_RANK = np.int32(2**31 - 1)
#: Room for the remembered words and for the remembered pre-tokens of a task, and the longest that are remembered.
WORD_ROOM = 32 << 20
PIECE_ROOM = 48 << 20
MEMO_BYTES = 128
MATRIX_CELLS = 1 << 19
#: From this width on a row is shifted by itself, which touches only the places behind its merge.
WIDE = 512
BATCH_CHARS = 1 << 21


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by byte string from a rank file: a line holds the string in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairTable:
    """Rank of the token that two tokens form, by their ids, for whole arrays of pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        lefts, rights, made = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    lefts.append(left), rights.append(right), made.append(rank)
        keys = self.key(np.array(lefts, np.int64), np.array(rights, np.int64))
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int32)
        values, slots = np.array(made, np.int32), self.slot(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of several keys for one slot the last stays
            placed = self.keys[slots] == keys
            self.ranks[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, NO_RANK for pairs that form no token or hold padding."""
        shape = left.shape
        left, right = left.ravel(), right.ravel()
        out = np.full(len(left), NO_RANK, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self.key(left[at], right[at])
        slots = self.slot(keys)
        while len(at):
            there = self.keys[slots]
            hit = there == keys
            out[at[hit]] = self.ranks[slots[hit]]
            on = ~hit & (there >= 0)
            at, keys, slots = at[on], keys[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(shape)


def _merge_matrix(ids: np.ndarray, pairs: PairTable) -> list[bytes]:
    """Final ids of each row of a padded matrix, as the bytes of an int32 array."""
    result = [b""] * len(ids)
    rows, lengths = np.arange(len(ids)), (ids >= 0).sum(1)
    ids = np.hstack([ids, np.full((len(ids), 1), -1, np.int32)])
    ranks = pairs.lookup(ids[:, :-1], ids[:, 1:])
    while len(rows):
        place = ranks.argmin(1)  # the leftmost of equal ranks
        line = np.arange(len(rows))
        best = ranks[line, place]
        live = best < NO_RANK
        if not live.all():
            done, step = ids[~live].tobytes(), ids.shape[1] * 4
            for i, (row, length) in enumerate(zip(rows[~live].tolist(), lengths[~live].tolist(), strict=True)):
                result[row] = done[i * step : i * step + 4 * length]
            width = int(lengths[live].max(initial=1)) + 1
            rows, lengths, ids, ranks = rows[live], lengths[live], ids[live, :width], ranks[live, : width - 1]
            place, best, line = place[live], best[live], np.arange(int(live.sum()))
            if not len(rows):
                break
        ids[line, place] = best
        if ids.shape[1] >= WIDE:
            for i, p in enumerate(place):
                ids[i, p + 1 : -1] = ids[i, p + 2 :]
                ranks[i, p:-1] = ranks[i, p + 1 :]
            ranks[:, -1] = NO_RANK
        else:
            columns = np.arange(ids.shape[1])
            ids = np.take_along_axis(ids, np.minimum(columns + (columns > place[:, None]), columns[-1]), 1)
            columns = columns[:-1]
            moved = columns + (columns >= place[:, None])
            ranks = np.where(moved < len(columns), np.take_along_axis(ranks, np.minimum(moved, len(columns) - 1), 1), NO_RANK)
        ids[:, -1] = -1
        lengths -= 1
        ranks[line, place] = pairs.lookup(ids[line, place], ids[line, place + 1])
        left = place > 0
        ranks[line[left], place[left] - 1] = pairs.lookup(ids[line[left], place[left] - 1], ids[line[left], place[left]])
    return result


def merge_pieces(pieces: list[bytes], byte_ids: np.ndarray, pairs: PairTable) -> dict[bytes, bytes]:
    """Ids, as the bytes of an int32 array, of each byte string. Strings of similar length share a matrix of at most
    MATRIX_CELLS cells."""
    pieces = sorted(pieces, key=len)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    merged: dict[bytes, bytes] = {}
    start = 0
    while start < len(pieces):
        least = max(4, int(lengths[start]))
        end = min(int(np.searchsorted(lengths, 1.5 * least, "right")), start + MATRIX_CELLS // (2 * least))
        end = max(end, start + 1)
        bucket, size = pieces[start:end], lengths[start:end]
        ids = np.full((len(bucket), int(size[-1])), -1, np.int32)
        ids[np.arange(ids.shape[1]) < size[:, None]] = byte_ids[np.frombuffer(b"".join(bucket), np.uint8)]
        merged.update(zip(bucket, _merge_matrix(ids, pairs), strict=True))
        start = end
    return merged


def _library_class(char: str) -> str:
    """Class of a character in the library: with which mark it forms one pre-token, and so one token of a tiny vocabulary."""
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {(m + char).encode(): 256 + i for i, m in enumerate(CLASS_MARKS)}
    tiny = tiktoken.Encoding("tiny", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return next((m for m in CLASS_MARKS if len(tiny.encode_ordinary(m + char)) == 1), " ")


class Codec:
    """Encodes batches of texts to arrays of ids and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pairs: PairTable, pattern: str):
        self.ranks, self.pairs = ranks, pairs
        self.split = Splitter(pattern, _library_class)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.pieces = Memo(PIECE_ROOM)
        self.words = Memo(WORD_ROOM)

    def ids_of(self, pieces: list[str], begins: list[int]) -> list[bytes]:
        """Ids, as the bytes of an int32 array, of runs of pre-tokens, given where each begins; pre-tokens not met before are merged
        together."""
        raw = [p.encode() for p in pieces]
        wanted = set(raw)
        have = self.pieces.known(wanted)
        new = wanted - have.keys()
        known = {p: np.int32(self.ranks[p]).tobytes() for p in new if p in self.ranks}
        known |= merge_pieces([p for p in new if p not in known], self.byte_ids, self.pairs)
        self.pieces.remember({p: ids for p, ids in known.items() if len(p) <= MEMO_BYTES})
        have |= known
        each = list(map(have.__getitem__, raw))
        data = b"".join(each)
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))])
        bounds = ends[np.append(np.array(begins, np.int64), len(each))].tolist()
        return [data[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin, with the end of the last. The first word of a text stands alone, the others
        follow a blank, and each different one is looked up once."""
        heads = texts.to_pylist()
        cut = np.fromiter((not self.split.blank_run.search(t) for t in heads), bool, len(heads))
        words = pc.split_pattern(texts.filter(pa.array(cut)), " ")
        first = pc.list_element(words, 0).to_pylist() if cut.any() else []
        for i, word in zip(np.flatnonzero(cut).tolist(), first, strict=True):
            heads[i] = word
        counts = np.zeros(len(heads), np.int64)
        counts[cut] = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64) - 1
        coded = pc.list_slice(words, 1).flatten().dictionary_encode()
        different = coded.dictionary.to_pylist()
        have = self.words.known(different)
        new, pieces, from_ = self.split.behind_blank([w for w in different if w not in have])
        for head in heads:
            from_.append(len(pieces))
            pieces += self.split(head)
        ids = self.ids_of(pieces, from_)
        known = dict(zip(new, ids[: len(new)], strict=True))
        self.words.remember({w: x for w, x in known.items() if len(w) <= MEMO_BYTES})
        have |= known
        # Places in one list, the different words and then the heads: of each text its head, then its other words.
        every = pa.array([*map(have.__getitem__, different), *ids[len(new) :]], pa.large_binary())
        begins = np.cumsum(counts + 1) - counts - 1
        places = np.empty(int(counts.sum()) + len(heads), np.int64)
        others = np.ones(len(places), bool)
        others[begins] = False
        places[others] = coded.indices.to_numpy(zero_copy_only=False)
        places[begins] = np.arange(len(different), len(every))
        data, ends = _joined(every, places)
        return np.frombuffer(data, np.int32), ends[np.append(begins, len(places))] // 4

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Bytes of each run of ids; ends: where each begins, with the end of the last."""
        data, places = _joined(self.tokens, ids)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(places[ends]), data])


def _joined(values: pa.Array, places: np.ndarray) -> tuple[pa.Buffer, np.ndarray]:
    """Values at some places side by side, and where each begins, with the end of the last."""
    if not len(places):
        return pa.py_buffer(b""), np.zeros(1, np.int64)
    taken = values.take(pa.array(places))
    _, ends, data = taken.buffers()
    return data if data is not None else pa.py_buffer(b""), np.frombuffer(ends, np.int64, len(taken) + 1, 8 * taken.offset)


def _in_parts(texts: pa.Array) -> Iterator[slice]:
    start = chars = 0
    for i, size in enumerate(pc.utf8_length(texts).to_pylist()):
        chars += size
        if chars >= BATCH_CHARS or i + 1 == len(texts):
            yield slice(start, i + 1)
            start, chars = i + 1, 0


def _sent_codec(docs: DataFrame, ranks_path: str | None, pattern: str | None) -> Callable[[], Codec]:
    ranks = read_ranks(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    pattern = pattern or public_tokenizers.PATTERN
    sent = docs.sparkSession.sparkContext.broadcast((ranks, PairTable(ranks)))
    return lambda: Codec(*sent.value, pattern)


def encode_decode(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    ranks_path: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Ids of every whole text, and the bytes that decoding those ids gives.

    Returns id_col, the columns to carry, ids array<int> and decoded binary, a row per row of docs: repeated rows and null ids are
    kept, a null or empty text has no ids and decodes to no bytes, other columns are left out, an empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    codec = _sent_codec(docs, ranks_path, pattern)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.struct(F.lit(True).alias("_"), *carry).alias("carried"),
    )
    schema = rows.select("id", "carried", F.array().cast("array<int>").alias("ids"), F.lit(b"").alias("decoded")).schema

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        own = codec()
        for batch in batches:
            texts = batch.column("text")
            for part in _in_parts(texts):
                ids, ends = own.encode(texts[part])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                decoded = own.decode(ids, ends).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[part], batch.column("carried")[part], lists, decoded], names=["id", "carried", "ids", "decoded"]
                )
        del own
        release_memory()

    return rows.mapInArrow(coded, schema).select(
        F.col("id").alias(id_col), *[F.col("carried")[c].alias(c) for c in carry], "ids", "decoded"
    )


def decode(
    rows: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", ranks_path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Bytes of each array of ids: id_col and decoded binary. A null or empty array gives no bytes; an id outside the
    vocabulary fails."""
    codec = _sent_codec(rows, ranks_path, pattern)
    rows = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    schema = rows.select("id", F.lit(b"").alias("decoded")).schema

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            lists = batch.column("ids")
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = own.decode(lists.flatten().to_numpy(zero_copy_only=False), ends).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), texts], names=["id", "decoded"])

    return rows.mapInArrow(decoded, schema).withColumnRenamed("id", id_col)
