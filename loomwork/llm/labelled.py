"""Labelled examples for the two classifiers, and scores for all documents.

The examples are a bounded sample: at most `most` labelled documents, those whose ids have the least hashes. The
bound is a parameter; scoring covers every row and the whole of every text, a thousand rows of a batch at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomwork.llm.common import numbered, pick

SAMPLE_ROWS = 8_000  #: labelled rows that a model is fitted on at most; their features are all that the driver holds


def is_held_out(doc_id, folds: int, fold: int):
    return (F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds) == fold


def examples(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, featurize: Callable[[str], np.ndarray], most: int = SAMPLE_ROWS
) -> tuple[list[np.ndarray], np.ndarray]:
    """(features, labels) of the sample, outside the held-out fold.

    Null ids and null labels are left out; of several labels of one document the largest counts, of several texts of one
    document the one whose features are least as bytes.
    """
    known = pick(labels, "doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.where(~is_held_out(F.col("doc_id"), folds, fold))
    chosen = (
        known.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [featurize(x.as_py() or "").astype("<u4").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["doc_id", "label", "features"])

    # at most `most` rows are broadcast
    joined = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    made = joined.mapInArrow(run, "doc_id long, label int, features binary").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("features").alias("features"))
    rows = made.orderBy("doc_id").collect()  # one for each sampled label
    return [np.frombuffer(r["features"], "<u4") for r in rows], np.array([r["label"] for r in rows], np.float64)


def scored(docs: DataFrame, score: Callable[[list[str]], np.ndarray], text: str = "text", column: str = "score") -> DataFrame:
    """docs with one more column, the score of `text`. Null texts are empty."""
    at = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(first, 1000) for whole in frames for first in range(0, whole.num_rows, 1000)):
            texts = [x.as_py() or "" for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(texts), pa.float64())], schema=batch.schema.append(pa.field(column, pa.float64())))

    return docs.mapInArrow(run, schema)


def filtered(docs: DataFrame, model, keep: Callable) -> DataFrame:
    """The rows of docs, all columns, whose score `keep` accepts; all of them if the model had nothing to tell apart.

    model: has `score(texts)` and `fitted`, which is False if there were no labels, or labels of one class only.
    """
    if not model.fitted:
        return docs
    plain, (text,) = numbered(docs, "text")
    return scored(plain, model.score, text).where(keep(F.col("score"))).drop("score").toDF(*docs.columns)


def verdicts(docs: DataFrame, score: Callable[[list[str]], np.ndarray], folds: int, fold: int, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    out = scored(pick(docs, "doc_id", "text"), score)
    return out.select(
        "doc_id",
        F.coalesce(is_held_out(F.col("doc_id"), folds, fold), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(a, b) such that sigmoid(a * margin + b) is the chance of label 1: Platt's fit by Newton steps, smoothed targets."""
    pos, neg = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        grad = x.T @ (p - target)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def accuracy(result: pd.DataFrame, truth: pd.Series) -> float:
    """Share of right predictions among held-out labelled rows; for tests and reports."""
    both = result[result["held_out"]].set_index("doc_id")["predicted"].to_frame().join(truth.rename("truth"), how="inner")
    return float((both["predicted"] == both["truth"]).mean())
