"""Secrets in texts: three fixed rules, and sliding windows of high entropy.

Everything is a column expression: no Python worker, no shuffle, and every row is looked at on its own.

The fixed rules are `assign` (a name such as password or api_key, a sign, and a value of eight or more characters), `access` (an
access key id) and `hex` (a long run of lower-case hex digits). A match runs over the whole pattern, the name included.

The entropy search adds to them what no rule describes. Candidates are the maximal runs of the characters that keys are written in.
A window slides over each; the counts of the characters in it are kept up by one step in and one step out, and so is the sum of
c * log2(c) over them, in whole numbers, from which the Shannon entropy of the window follows. The class of a candidate (hex digits,
or a mixture) says how much entropy is asked for. Windows that reach it and touch make one span. Candidates of an allow-list
(plain numbers, words and numbers joined by signs, as in paths and slugs, UUIDs, the alphabet) are left out. What a fixed rule found
is never suppressed, and an entropy span may lie over it.

Nulls count as empty; an empty text has no span; rows are returned one for one, repeated ids or not; an empty table gives an empty
one. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import floor, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def either_case(word: str) -> str:
    """Pattern of a word in either case, ASCII letters only, in every dialect."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
VALUE_LENGTH = 8
# Runs are maximal, so that one that is too short holds none that is long enough.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
BASE_KINDS = ("assign", "access", "hex")

WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_-]{{{WINDOW},}}"
HEX_CLASS = "^[0-9A-Fa-f]+$"
#: Least bits of entropy of a window, by class of the candidate, and the kinds of their spans.
HEX_BITS = 3.0
MIXED_BITS = 3.7
ENTROPY_KINDS = ("hex_entropy", "mixed_entropy")
#: Candidates that match one of these as a whole are no secrets. The possessive loop needs no stack, however long they are.
ALLOWED = (
    "[0-9]+",
    "(?:[A-Za-z]+|[0-9]{1,6})(?:[-+_/]+(?:[A-Za-z]+|[0-9]{1,6}))*+[-+_/]*",
    "[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}",
    ".*(?:abcdefghij|ABCDEFGHIJ|0123456789).*",
)

#: Entropies are compared as whole numbers of this fraction of a bit.
SCALE = 1 << 20
#: Windows of a candidate that one fold counts, and numbers that one fold adds up.
PIECE = 4096
CHUNK = 256
FIRST_CODE = ord("+")
CODES = ord("z") - FIRST_CODE + 1
ZERO = ord("0")


def weights(width: int) -> list[int]:
    """Scaled c * log2(c) for counts c up to the width."""
    return [0] + [round(c * log2(c) * SCALE) for c in range(1, width + 1)]


def highest_sum(width: int, bits: float) -> int:
    """The most that the weights of a window may sum up to, if its entropy is to reach some bits."""
    return floor(width * (log2(width) - bits) * SCALE)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _numbers(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _running_sums(numbers: Column) -> Column:
    """Sums of the first 1, 2, ... entries of a non-empty array, in chunks, so that the cost stays near the length."""

    def summed(part: Column) -> Column:
        zero = F.array(F.lit(0))
        return F.aggregate(part, zero, lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))

    def joined(parts: Column, offsets: Column) -> Column:
        shifted = F.transform(parts, lambda p, k: F.transform(F.slice(p, 2, F.size(p) - 1), lambda n: n + F.get(offsets, k)))
        return F.flatten(shifted)

    def chunks(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: summed(F.slice(all_, k * CHUNK + 1, F.lit(CHUNK))))

    def sums(parts: Column) -> Column:
        totals = summed(F.transform(parts, lambda p: F.element_at(p, -1)))
        return _let(totals, lambda offsets: joined(parts, offsets))

    return _let(numbers, lambda all_: _let(chunks(all_), sums))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches of a pattern: array of begin, end (code points, end exclusive) and found, the text of a
    group of the pattern."""
    none = F.array().cast("array<struct<begin:int,end:int,found:string>>")

    def placed(whole: Column) -> Column:
        before = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
        steps = F.zip_with(before, whole, lambda b, w: F.char_length(b) + F.char_length(w))
        groups = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        rows = F.arrays_zip(whole.alias("whole"), _running_sums(steps).alias("end"), groups.alias("found"))
        return F.transform(
            rows,
            lambda r: F.struct(
                (r["end"] - F.char_length(r["whole"])).alias("begin"), r["end"].alias("end"), r["found"].alias("found")
            ),
        )

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), _let(whole, placed)).otherwise(none)


def _of_kind(spans: Column, kind: Column, order: Column) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["begin"].alias("begin"), order.alias("place"), s["end"].alias("end"), kind.alias("kind"))
    )


def _base(text: Column) -> Column:
    found = (
        F.filter(matches(text, ASSIGN, group=2), lambda m: F.char_length(m["found"]) >= VALUE_LENGTH),
        matches(text, ACCESS),
        matches(text, HEX),
    )
    return F.concat(*[_of_kind(f, F.lit(k), F.lit(i)) for i, (k, f) in enumerate(zip(BASE_KINDS, found, strict=True))])


def _grown(spans: Column, begin: Column, end: Column) -> Column:
    """Spans in order with one more, which is joined to the last one if they touch."""
    new = F.array(F.struct(begin.alias("begin"), end.alias("end")))
    last = F.element_at(spans, -1)
    longer = F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["end"], end).alias("end")))
    touches = (F.size(spans) > 0) & (F.get(spans, F.size(spans) - 1)["end"] >= begin)
    return F.when(touches, F.concat(F.slice(spans, 1, F.size(spans) - 1), longer)).otherwise(F.concat(spans, new))


def _high_windows(text: Column, most: Column, width: int) -> Column:
    """Spans of touching windows of a text whose sum of weights is at most `most`, by incremental counts. The counts are kept as
    one character per code, so that a step replaces two of them."""
    weight = weights(width)
    gain = _numbers([b - a for a, b in zip(weight, weight[1:], strict=False)])
    no_spans = F.array().cast("array<struct<begin:int,end:int>>")

    def count(counts: Column, code: Column) -> Column:
        return F.ascii(F.substring(counts, code, 1)) - ZERO

    def slid(codes: Column, limit: Column) -> Column:
        start = F.struct(
            F.lit(chr(ZERO) * CODES).alias("counts"), F.lit(0).cast("long").alias("sum"), no_spans.alias("spans")
        )

        def step(state: Column, i: Column) -> Column:
            counts, enters, leaves = state["counts"], F.get(codes, i), F.get(codes, i - width)
            more, less = count(counts, enters), count(counts, leaves)
            one_in = F.overlay(counts, F.char(more + (ZERO + 1)), enters, F.lit(1))
            one_out = F.overlay(one_in, F.char(less + (ZERO - 1)), leaves, F.lit(1))
            total = (
                F.when(i < width, state["sum"] + F.get(gain, more))
                .when(enters == leaves, state["sum"])
                .otherwise(state["sum"] + F.get(gain, more) - F.get(gain, less - 1))
            )
            kept = F.when(i < width, one_in).when(enters == leaves, counts).otherwise(one_out)
            return _let(
                total,
                lambda s: F.struct(
                    kept.alias("counts"),
                    s.alias("sum"),
                    F.when((i >= width - 1) & (s <= limit), _grown(state["spans"], i - (width - 1), i + 1))
                    .otherwise(state["spans"])
                    .alias("spans"),
                ),
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda state: state["spans"])

    def of_piece(offset: Column) -> Column:
        piece = F.substring(text, offset + 1, F.lit(PIECE + width - 1))
        codes = F.transform(F.split(piece, ""), lambda c: F.ascii(c) - (FIRST_CODE - 1))
        spans = _let(codes, lambda c: slid(c, most))
        return F.transform(spans, lambda s: F.struct((s["begin"] + offset).alias("begin"), (s["end"] + offset).alias("end")))

    pieces = F.transform(F.sequence(F.lit(0), F.char_length(text) - width, F.lit(PIECE)), of_piece)
    return F.aggregate(F.flatten(pieces), no_spans, lambda done, s: _grown(done, s["begin"], s["end"]))


def _entropy(text: Column, allowed: Sequence[str], hex_bits: float, mixed_bits: float) -> Column:
    candidates = matches(text, CANDIDATE)
    if allowed:
        harmless = "^(?:" + "|".join(f"(?:{a})" for a in allowed) + ")$"
        candidates = F.filter(candidates, lambda c: ~c["found"].rlike(harmless))

    def spans(candidate: Column) -> Column:
        hex_digits = candidate["found"].rlike(HEX_CLASS)
        most = F.when(hex_digits, highest_sum(WINDOW, hex_bits)).otherwise(highest_sum(WINDOW, mixed_bits)).cast("long")
        found = F.transform(
            _high_windows(candidate["found"], most, WINDOW),
            lambda s: F.struct((s["begin"] + candidate["begin"]).alias("begin"), (s["end"] + candidate["begin"]).alias("end")),
        )
        first = len(BASE_KINDS)
        kind = F.when(hex_digits, ENTROPY_KINDS[0]).otherwise(ENTROPY_KINDS[1])
        return _of_kind(found, kind, F.when(hex_digits, first).otherwise(first + 1))

    return F.flatten(F.transform(candidates, spans))


def as_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    allowed: Sequence[str] = ALLOWED,
    hex_bits: float = HEX_BITS,
    mixed_bits: float = MIXED_BITS,
) -> DataFrame:
    """Spans of likely secrets of each row: id_col, base and spans.

    Both are arrays of begin, place (the number of the kind), end and kind, in this order of comparison: base those of the fixed
    rules, spans these and those of high entropy. Places are code points, the end exclusive. `allowed` are patterns of candidates
    of the entropy search that are left out if one matches the whole candidate.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.select(
        "id", _base(F.col("text")).alias("base"), _entropy(F.col("text"), allowed, hex_bits, mixed_bits).alias("added")
    )
    return found.select(
        F.col("id").alias(id_col), F.sort_array("base").alias("base"), F.sort_array(F.concat("base", "added")).alias("spans")
    )
