"""Language identification by string kernels.

Kernel: two texts are as alike as the number of n-grams (of 1 to 3 characters, hashed to buckets, present or not, however
often) that both hold, divided by the root of the numbers each holds. Nyström: some of the labelled rows are landmarks; the
n-grams are those of the landmarks, and a text's features are its kernel values with them, whitened by the landmarks' own
kernel matrix. On these features one ridge regression per language tells it from the rest.

The model is fitted on the driver from a bounded sample: at most rows_per_language labelled rows of each language, those with
the least hash of their id, of which landmarks rows in all are landmarks. Every text is then scored whole, in batches: a
matrix of n-gram presence times that of the landmarks, times the weights. No row depends on another; there is no shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_BITS = 18
BATCH_ROWS = 128
SHARPNESS = 4.0
NO_LANGUAGE = "und"


@dataclass
class Model:
    """languages: in order of code point. column: of each bucket, the last one for buckets that no landmark has."""

    languages: list[str]
    column: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def buckets(text: str, letters: np.ndarray, longest: int = 3) -> tuple[np.ndarray, bool]:
    """Buckets of all n-grams of the lower-cased text, and whether it has a letter. Each run of other characters is one blank;
    the text begins and ends with one."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters[points]
    points = np.where(is_letter, points, np.uint32(32))
    points = points[is_letter | np.concatenate([[True], is_letter[:-1]])]
    grams, state = [], np.zeros(len(points), np.uint32)
    for n in range(min(longest, len(points))):
        state = (state[: len(points) - n] ^ points[n:]) * np.uint32(0x9E3779B1)
        state = (state ^ (state >> np.uint32(15))) * np.uint32(0x85EBCA77)
        grams.append(state >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(grams), bool(is_letter.any())


def _presence(found: list[np.ndarray], column: np.ndarray, width: int) -> np.ndarray:
    matrix = np.zeros((len(found), width + 1), np.float32)
    for row, grams in zip(matrix, found, strict=True):
        row[column[grams]] = 1
    return matrix[:, :width]


def _kernel(present: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.outer(present.sum(1), landmarks.sum(1)))
    return (present @ landmarks.T) / np.maximum(size, 1)


def fit(texts: list[str], labels: list[str], landmarks: int = 128, ridge: float = 1e-3) -> Model:
    """Fits on the driver. Landmarks are taken from the languages in turn, in the order given."""
    letters = letter_table()
    languages = sorted(set(labels))
    found = [buckets(t, letters)[0] for t in texts]
    turn = pd.Series(labels).groupby(labels).cumcount().to_numpy()
    chosen = np.argsort(turn, kind="stable")[:landmarks]
    used = np.unique(np.concatenate([found[i] for i in chosen]))
    column = np.full(1 << BUCKET_BITS, len(used), np.int32)
    column[used] = np.arange(len(used))
    marks = _presence([found[i] for i in chosen], column, len(used))
    near = _kernel(marks, marks).astype(np.float64)
    values, vectors = np.linalg.eigh(near)
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    with_marks = np.vstack(
        [_kernel(_presence(found[i : i + BATCH_ROWS], column, len(used)), marks) for i in range(0, len(found), BATCH_ROWS)]
    )
    features = with_marks.astype(np.float64) @ whiten
    goals = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    middle, mean = features.mean(0), goals.mean(0)
    centred = features - middle
    inner = centred.T @ centred + ridge * len(texts) * np.eye(centred.shape[1])
    solved = np.linalg.solve(inner, centred.T @ (goals - mean))
    return Model(languages, column, marks, (whiten @ solved).astype(np.float32), (mean - middle @ solved).astype(np.float32))


def training_sample(
    docs: DataFrame, trainable: Column, *, id_col: str, text_col: str, lang_col: str, rows_per_language: int
) -> list[tuple[str, str]]:
    """Languages and whole texts of the sample, in the order of their hash. Rows without text or language are not used; of
    rows with the same id the least text is. The first pass reads no texts, and each task cuts its rows before the shuffle."""
    rows = docs.filter(trainable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("mark"), F.col(text_col).alias("text")
    )
    order = W.partitionBy("lang").orderBy("mark")
    marks = rows.select("lang", "mark").withColumn("place", F.row_number().over(order))
    marks = marks.filter(F.col("place") <= rows_per_language).select("lang", "mark").distinct()
    picked = rows.join(F.broadcast(marks), ["lang", "mark"]).groupBy("lang", "mark").agg(F.min("text").alias("text"))
    return [(r.lang, r.text) for r in sorted(picked.collect(), key=lambda r: (r.mark, r.lang))]


def train(
    docs: DataFrame,
    trainable: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = 200,
    landmarks: int = 128,
    ridge: float = 1e-3,
) -> Model | None:
    """The model of the trainable rows, None if none has a text with its language."""
    sample = training_sample(
        docs, trainable, id_col=id_col, text_col=text_col, lang_col=lang_col, rows_per_language=rows_per_language
    )
    return fit([t for _, t in sample], [lang for lang, _ in sample], landmarks, ridge) if sample else None


def score_texts(texts: list[str | None], model: Model, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
    found, speaks = zip(*[buckets(t or "", letters) for t in texts], strict=True)
    present = _presence(list(found), model.column, model.landmarks.shape[1])
    raw = _kernel(present, model.landmarks) @ model.weights + model.bias
    raw = np.exp(SHARPNESS * (raw - raw.max(1, keepdims=True)))
    best = raw.argmax(1)
    share = raw[np.arange(len(raw)), best] / raw.sum(1)
    names = [model.languages[b] if s else NO_LANGUAGE for b, s in zip(best, speaks, strict=True)]
    return names, np.where(speaks, share, 0.0).astype(np.float64)


def predicted(docs: DataFrame, text: Column, model: Model | None) -> Column:
    """Struct of lang and score (0 to 1) for each whole text. `und` with score 0 for a null text, one without letters, or if
    there is no model. Ties go to the language first by code point."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, letters = sent.value, letter_table()
        for batch in batches:
            names, scores = [NO_LANGUAGE] * len(batch), np.zeros(len(batch))
            if own is not None:
                texts = batch.tolist()
                for start in range(0, len(texts), BATCH_ROWS):
                    part = slice(start, start + BATCH_ROWS)
                    names[part], scores[part] = score_texts(texts[part], own, letters)
            yield pd.DataFrame({"lang": names, "score": scores})

    return predict(text)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold


def identify(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 5,
    fold: int = 0,
    rows_per_language: int = 200,
    landmarks: int = 128,
    ridge: float = 1e-3,
) -> DataFrame:
    """Predicted language of every whole text: id_col, held_out, lang_pred, score, a row per row of docs.

    Rows of the held-out fold are not learned from. Repeated rows and null ids are kept, other columns are left out.
    """
    out = held_out(id_col, folds, fold)
    model = train(
        docs,
        ~out,
        id_col=id_col,
        text_col=text_col,
        lang_col=lang_col,
        rows_per_language=rows_per_language,
        landmarks=landmarks,
        ridge=ridge,
    )
    rows = docs.select(id_col, out.alias("held_out"), predicted(docs, F.col(text_col), model).alias("found"))
    return rows.select(id_col, "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
