"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints that differ in at most d bits, cut into b blocks, agree in at least b - d whole blocks. So every distinct
fingerprint is filed under each choice of b - d blocks and what they hold; equal keys are joined and the Hamming distance is
verified. Equal fingerprints meet before the join, as one, so that groups of copies of any size make no pairs. With the
default of 8 blocks of 8 bits and 2 bits, a key fixes 48 bits, which leaves a group at most 2^16 distinct fingerprints, however
large the data are.

Links between distinct fingerprints go to star contractions; a document gets the least id of its component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.components import components
from assayline.llm.storage import stored

BITS = 64
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
FOLD = bytes.maketrans(UPPER, LOWER)
BLOCK_SHINGLES = 1 << 16


def simhash(text: str, words: int = 3, seed: int = 42) -> int:
    """Fingerprint of a text as a signed 64-bit number: a bit is set if it is set in over half of the shingles' hashes.
    A text of fewer words is one shingle, one without words has the fingerprint 0."""
    found = text.encode().translate(FOLD).split()  # white space of bytes is \\x20 and \\x09-\\x0D
    if not found:
        return 0
    parts = [found[i:] for i in range(words)] if len(found) >= words else [[b" ".join(found)]]
    shingles = map(b" ".join, zip(*parts, strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), BLOCK_SHINGLES):
        block = hashes[start : start + BLOCK_SHINGLES].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42
) -> DataFrame:
    """id_col and fingerprint (long) of each row; a null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = rows.select("id", F.lit(0).cast("long").alias("fingerprint")).schema

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [simhash(t.as_py(), words, seed) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(marks, pa.int64())], names=["id", "fingerprint"])

    return rows.mapInArrow(marked, schema).withColumnRenamed("id", id_col)


def close_pairs(marks: DataFrame, max_bits: int = 2, blocks: int = 8) -> DataFrame:
    """Pairs a < b of the distinct values of marks.fingerprint that differ in at most max_bits bits, each pair once."""
    width, wider = divmod(BITS, blocks)
    sizes = [width + (i < wider) for i in range(blocks)]
    starts = [sum(sizes[:i]) for i in range(blocks)]
    masks = []
    for chosen in combinations(range(blocks), blocks - max_bits):
        mask = sum(((1 << sizes[i]) - 1) << starts[i] for i in chosen)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    filed = marks.select("fingerprint").distinct().select(
        "fingerprint", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("choice", "mask")
    )
    filed = filed.select("fingerprint", "choice", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("held"))
    # Spark takes the filed rows to be as few as the fingerprints they are exploded from, and would broadcast them.
    left = filed.withColumnRenamed("fingerprint", "a").hint("merge")
    right = filed.withColumnRenamed("fingerprint", "b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # The first choice that holds all blocks in which the two agree: of the keys they share only that one gives the pair.
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(i)) for i, m in enumerate(masks)])
    return (
        left.join(right, ["choice", "held"])
        .filter((F.col("a") < F.col("b")) & (F.bit_count(differ) <= max_bits) & (F.col("choice") == first))
        .select("a", "b")
    )


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    max_bits: int = 2,
    blocks: int = 8,
    seed: int = 42,
) -> DataFrame:
    """Documents with their fingerprint and the least id of all documents that links of at most max_bits bits reach.

    Returns id_col, fingerprint (16 hexadecimal digits) and component_id, a row per row of docs. Repeated rows are kept; null
    and empty texts have the fingerprint 0 and are linked like others; a row with a null id is a document whose id never is the
    least, so a component of such rows alone has a null component_id. Other columns are left out.
    """
    marks = stored(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, seed=seed), "fingerprints")
    least = marks.groupBy("fingerprint").agg(F.min(id_col).alias("least"))
    joined = components(close_pairs(marks, max_bits, blocks))
    of = least.join(joined.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")
    )
    of = stored(of, "members")
    heads = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of.select("fingerprint", "component").join(heads, "component").select("fingerprint", "component_id")
    return marks.join(named, "fingerprint").select(
        id_col, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
