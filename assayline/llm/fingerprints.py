"""Document fingerprints as threshold-scaled sketches, in DataFrame functions only.

A text's shingles of five words are hashed, and every hash below a fixed fraction of the range is kept, once. So a sketch grows
with its text, the share of one text's sketch that another's holds estimates the share of its shingles there, whatever the two
sizes, and the sketch of several texts together is the union of theirs. A text whose hashes all lie above the fraction keeps its
least hash instead; a union that has any hash below the fraction drops such stand-ins.

The next document is found without a global order in one task: documents are dealt to ranges of their ids at approximate
quantiles, ordered inside each range, and the first row of a range is sent as a guest to the end of the range before it. Texts are
shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Hashes are of 63 bits.
HASH_BITS = 63


def with_sketch(df: DataFrame, text: str, name: str, *, words: int = 5, one_in: int = 4) -> DataFrame:
    """Adds the sketch of a text column: ascending distinct hashes. A text of fewer words is one shingle of all its words, one
    without words (or null) has an empty sketch."""
    word, hashed, all_ = f"_{name}_words", f"_{name}_shingles", f"_{name}_kept"
    count = F.size(word)
    run = F.xxhash64(*[F.get(F.col(word), F.lit(j)) for j in range(words)])

    def shingle(i: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*[F.get(F.col(word), i + j) for j in range(words)]), 1)

    shingles = (
        F.when(count >= words, F.transform(F.sequence(F.lit(0), F.greatest(count - words, F.lit(0))), shingle))
        .when(count > 0, F.array(F.shiftrightunsigned(run, 1)))
        .otherwise(F.array().cast("array<bigint>"))
    )
    below = (1 << HASH_BITS) // one_in
    return (
        df.withColumn(
            word, F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0), lambda w: F.xxhash64(w))
        )
        .withColumn(hashed, shingles)
        .withColumn(all_, F.filter(hashed, lambda h: h < below))
        .withColumn(
            name,
            F.when(F.size(all_) > 0, F.array_sort(F.array_distinct(all_)))
            .when(F.size(hashed) > 0, F.array(F.array_min(hashed)))
            .otherwise(F.array().cast("array<bigint>")),
        )
        .drop(word, hashed, all_)
    )


def merged(one: Column, other: Column, *, one_in: int = 4) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""
    union = F.array_sort(F.array_union(one, other))
    kept = F.filter(union, lambda h: h < (1 << HASH_BITS) // one_in)
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(union, 1, 1))


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of part's shingles that whole has; an empty part is contained in an empty text only."""
    shared = F.size(F.array_intersect(part, whole))
    return F.when(F.size(part) > 0, shared / F.size(part)).otherwise((F.size(whole) == 0).cast("double"))


def likeness(one: Column, other: Column) -> Column:
    """Estimated share of the shingles of the text with fewer of them that the other has: 1 for equal texts, 0 for texts without
    a common shingle."""
    return F.when(F.size(one) <= F.size(other), containment(one, other)).otherwise(containment(other, one))


def as_text(sketch: Column) -> Column:
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.hex(h)), "."))


def _with_range(docs: DataFrame, ranges: int) -> DataFrame:
    """Adds the range of each id: from 0 up, -1 for null."""
    shares = [i / ranges for i in range(1, ranges)]
    cuts = docs.agg(F.percentile_approx("id", shares, 20 * ranges)).first()[0] or []
    found = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    return docs.withColumn(
        "range", F.when(F.col("id").isNull(), -1).otherwise(F.size(F.filter(found, lambda c: c <= F.col("id"))))
    )


def with_next_text(docs: DataFrame, ranges: int) -> tuple[DataFrame, W]:
    """Rows (range, guest, id, text, next_text) of docs (id, text) in descending order of id, null last, ties by text; the last is
    followed by the first. Rows with guest = 1 are copies at the ends of ranges, to be dropped. Also the window."""
    rows = _with_range(docs, ranges)
    everything = W.orderBy(F.desc("range"))
    heads = rows.groupBy("range").agg(F.max("id").alias("head"))
    heads = heads.withColumn("before", F.lag("range").over(everything))
    heads = heads.withColumn("lowest", F.min("range").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = heads.select(F.col("range").alias("own"), "head", F.coalesce("before", "lowest").alias("to"))
    # As many heads as ranges: a parameter.
    guests = rows.join(F.broadcast(heads), (F.col("range") == F.col("own")) & F.col("id").eqNullSafe(F.col("head")))
    guests = guests.groupBy("to").agg(F.min("text").alias("text"))
    both = rows.select("range", F.lit(0).alias("guest"), "id", "text").unionByName(
        guests.select(F.col("to").alias("range"), F.lit(1).alias("guest"), F.lit(None).cast("long").alias("id"), "text")
    )
    window = W.partitionBy("range").orderBy("guest", F.col("id").desc_nulls_last(), "text")
    return both.withColumn("next_text", F.lead("text").over(window)), window


def fingerprint_edits(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, one_in: int = 4, ranges: int | None = None
) -> DataFrame:
    """Fingerprints of every whole text, of its edit, and how alike they are.

    The edit replaces the last floor(n / 2) code points by the first as many (or all) of the next document. Returns id_col,
    n_chars, edited (text), sketch, edited_sketch (arrays), near_edited and near_next, a row per row of docs. Null texts count as
    empty; rows with a null id are documents, last in order; repeated ids are ordered by text; a single document is its own next
    one; other columns are left out.
    """
    spark = docs.sparkSession
    ranges = ranges or min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 2000)
    rows, window = with_next_text(
        docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), ranges
    )
    rows = with_sketch(rows, "text", "sketch", words=words, one_in=one_in)
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(window)).filter("guest = 0")
    size = F.char_length("text")
    moved = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - moved), F.substring("next_text", F.lit(1), moved))
    rows = with_sketch(rows.withColumn("edited", edited), "edited", "edited_sketch", words=words, one_in=one_in)
    return rows.select(
        F.col("id").alias(id_col),
        size.cast("long").alias("n_chars"),
        "edited",
        "sketch",
        "edited_sketch",
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
