r"""Hard-negative mining by norm-bucketed search of largest inner products.

Rows are sorted by norm and cut into buckets of BUCKET rows, each with its largest norm. A bucket is a row of packed vectors; buckets are dealt in turn to slices, so each slice
holds norms of every size, largest first. Anchors are packed into groups likewise, and every group meets every slice in one task of
bounded size (the anchors are a stated set, and blocks of them against blocks of all rows are the work itself). A task goes through its buckets from the largest norm down. By Cauchy-Schwarz no row of a bucket scores
over |anchor| * norm; so for the search of positives a bucket is left out for those anchors whose running fifth score is over that bound, and for negatives for those windows whose
lower limit, or running tenth score, is. Where norms are nearly equal the bounds seldom leave out a bucket, and the search is a plain product of blocks. Only the best of each slice and
anchor are shuffled, and a window keeps the best over all slices.

Vectors are floor(256 * x) of each component x, as whole numbers; scores are exact: products run in float64 while |a| * |b| is below 2^53, else in
Python's whole numbers (and are cut at 64 bits).

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; a null vec_id is no anchor, and is the largest in ties; repeated rows
each count for themselves, as anchors too (a copy of an anchor is another row of its label); vectors of different lengths are compared as far as the longer goes, with zeros behind the shorter; an empty vector
scores 0 with all; an empty table gives no rows; a label or a vector that a third of all rows have is spread over all slices; columns are picked by exact name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import pick, small, stage

BUCKET, SLICE_ROWS, GROUP = 256, 8192, 2048  #: rows of a bucket, of a slice, anchors of a group
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  #: percent of the positive's score
NONE, NO_ID = -(1 << 63), (1 << 63) - 1  #: below every score; stands for a null id
PACKED = "part int, block int, norm double, n int, width int, ids binary, rows binary, labels binary, norms binary, vectors binary, scores binary"


def _prepared(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, vector, norm): the rows that take part, with whole components and a number for each row."""
    rows = pick(vectors, "vec_id", "embedding", "label").where(F.col("label").isNotNull() & F.col("embedding").isNotNull())
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # beyond 2^52 a double is whole; beyond 1e300 products are cut anyway
    whole = F.transform(x, lambda v: F.when(F.abs(v) < float(1 << 44), F.floor(v * 256).cast("double")).otherwise(F.least(F.greatest(v * 256, F.lit(-1e300)), F.lit(1e300))))
    return rows.where(F.coalesce(finite, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        whole.alias("vector"),
        F.least(F.sqrt(F.aggregate(whole, F.lit(0.0), lambda a, v: a + v * v)), F.lit(1e150)).alias("norm"),
    )


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks (PACKED) of at most `size` rows (row, vec_id, label, vector, norm, score), in the order of each partition."""
    names = [x.split()[0] for x in PACKED.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32()] + [pa.binary()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, left = TaskContext.get().partitionId(), 0, None

        def block(t: pa.Table) -> pa.RecordBatch:
            nonlocal made
            lists = t["vector"].to_pylist()
            m = np.zeros((len(lists), max(map(len, lists))))
            for k, v in enumerate(lists):
                m[k, : len(v)] = v
            norms = t["norm"].to_numpy()
            longs = [t[c].combine_chunks().fill_null(NO_ID).to_numpy().tobytes() for c in ("vec_id", "row", "label")]
            values = [part, made, norms.max(), len(lists), m.shape[1], *longs, norms.tobytes(), m.tobytes(), t["score"].to_numpy().tobytes()]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            t = pa.concat_tables([*([left] if left is not None else []), pa.Table.from_batches([batch])])
            whole = t.num_rows - t.num_rows % size
            for at in range(0, whole, size):
                yield block(t.slice(at, size))
            left = t.slice(whole)
        if left is not None and left.num_rows:
            yield block(left)

    return rows.select("row", "vec_id", "label", "vector", "norm", "score").mapInArrow(run, PACKED)


def _buckets(rows: DataFrame, n: int) -> tuple[DataFrame, int]:
    """All rows in buckets by norm, with the slice of each; the number of slices."""
    slices = max(1, -(-n // SLICE_ROWS))
    by_norm = rows.repartitionByRange(max(1, -(-n // (4 * SLICE_ROWS))), F.desc("norm"), "vec_id", "row").sortWithinPartitions(F.desc("norm"), "vec_id", "row")
    packed = stage(_pack(by_norm.withColumn("score", F.lit(0).cast("long")), BUCKET), "buckets")
    return packed.withColumn("slice", F.pmod(F.col("part") + F.col("block"), F.lit(slices)).cast("int")), slices


def _groups(searches: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Searches (rows as _pack takes them), those of one anchor together, in groups of about GROUP; the number of groups."""
    by_anchor = searches.repartitionByRange(max(1, -(-n // GROUP)), "row").sortWithinPartitions("row", "score")
    packed = stage(_pack(by_anchor, GROUP), "searches")
    # a row for up to GROUP searches; small blocks share a group
    ends = packed.select("part", "block", F.floor((F.sum("n").over(Window.orderBy("part", "block")) - 1) / GROUP).cast("int").alias("group"))
    most = ends.agg(F.max("group")).first()[0]
    return packed.join(small(ends), ["part", "block"]), 0 if most is None else most + 1


class _Block:
    def __init__(self, r: dict):
        self.ids, self.rows, self.labels, self.scores = (np.frombuffer(r[c], np.int64) for c in ("ids", "rows", "labels", "scores"))
        self.norms, self.vectors = np.frombuffer(r["norms"]), np.frombuffer(r["vectors"]).reshape(r["n"], r["width"])


def _blocks(table: pa.Table) -> list[_Block]:
    """The blocks of a table, largest norms first."""
    return [_Block(r) for r in sorted(table.to_pylist(), key=lambda r: (-r["norm"], r["part"], r["block"]))]


def products(a: _Block, at: np.ndarray, b: _Block) -> np.ndarray:
    """The exact scores of a's rows `at` with all of b: whole numbers as int64."""
    width = min(a.vectors.shape[1], b.vectors.shape[1])
    x, y = a.vectors[at, :width], b.vectors[:, :width]
    if a.norms[at].max(initial=0) * b.norms.max() < 1 << 52:
        return (x @ y.T).astype(np.int64)
    exact = np.array([[sum(int(p) * int(q) for p, q in zip(u, v, strict=True)) for v in y] for u in x], object).reshape(len(x), len(y))
    return np.clip(exact, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)


class _Best:
    """The k best rows of each of n searches so far: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.of, self.scores, self.ids, self.rows = (np.zeros(0, np.int64) for _ in range(4))
        self.kth = np.full(n, NONE)

    def add(self, of: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        of, scores, ids, rows = (np.concatenate(x) for x in ((self.of, of), (self.scores, scores), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((rows, ids, -scores, of))
        of = of[order]
        first = np.searchsorted(of, of)  # where each search's rows begin
        keep = np.arange(len(of)) - first < self.k
        order = order[keep]
        self.of, self.scores, self.ids, self.rows = of[keep], scores[order], ids[order], rows[order]
        full = np.flatnonzero(np.arange(len(self.of)) - np.searchsorted(self.of, self.of) == self.k - 1)
        self.kth[self.of[full]] = self.scores[full]


def _offer(best: _Best, searches: np.ndarray, scores: np.ndarray, allowed: np.ndarray, bucket: _Block) -> None:
    """Add to the searches those of a bucket's rows that are allowed and may be among the best; all ties of the last place come along."""
    allowed &= scores >= best.kth[searches, None]
    if scores.shape[1] > best.k:
        shown = np.where(allowed, scores, NONE)
        last = np.partition(shown, scores.shape[1] - best.k, axis=1)[:, scores.shape[1] - best.k]
        allowed &= shown >= last[:, None]
    i, j = np.nonzero(allowed)
    if len(i):
        best.add(searches[i], scores[i, j], bucket.ids[j], bucket.rows[j])


def _bound(norms: np.ndarray, bucket: _Block) -> np.ndarray:
    """No row of the bucket scores more. Rounded up by more than the errors of norms and product."""
    return norms * bucket.norms.max() * (1 + 1e-9) + 1


def best_positives(anchors: _Block, buckets: list[_Block], k: int = POSITIVES) -> _Best:
    """The k best other rows of each anchor's label."""
    best = _Best(len(anchors.ids), k)
    for b in buckets:
        at = np.flatnonzero(_bound(anchors.norms, b) >= best.kth)
        if not len(at):
            continue
        scores = products(anchors, at, b)
        _offer(best, at, scores, (anchors.labels[at, None] == b.labels) & (anchors.rows[at, None] != b.rows), b)
    return best


def best_negatives(windows: _Block, buckets: list[_Block], k: int = NEGATIVES) -> _Best:
    """The k best rows of each window's range of scores and another label than its anchor's. windows: a row for each anchor and positive, with the positive's score."""
    low = np.array([-(-LOW * p // 100) for p in windows.scores.tolist()], np.int64)
    high = np.array([HIGH * p // 100 for p in windows.scores.tolist()], np.int64)
    best = _Best(len(low), k)
    _, first, of = np.unique(windows.rows, return_index=True, return_inverse=True)  # the windows of an anchor share its products
    for b in buckets:
        bound = _bound(windows.norms, b)
        some = np.flatnonzero((low <= high) & (bound >= np.maximum(low, best.kth)))
        if not len(some):
            continue
        at, where = np.unique(of[some], return_inverse=True)
        scores, other = products(windows, first[at], b), windows.labels[first[at], None] != b.labels
        for a in range(0, len(some), 1024):
            w, s = some[a : a + 1024], where[a : a + 1024]
            _offer(best, w, scores[s], other[s] & (scores[s] >= low[w, None]) & (scores[s] <= high[w, None]), b)
    return best


def _grid(groups: DataFrame, n_groups: int, buckets: DataFrame, slices: int, search: Callable[[_Block, list[_Block]], _Best]) -> DataFrame:
    """(anchor, positive_score, row, vec_id, score): what `search` finds for each group of searches in each slice of buckets, both of bounded size."""
    columns = ("anchor", "positive_score", "row", "vec_id", "score")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({c: pa.array([], pa.int64()) for c in columns})]
        buckets = _blocks(right)
        for a in _blocks(left):
            best = search(a, buckets)
            out.append(pa.table(dict(zip(columns, (a.rows[best.of], a.scores[best.of], best.rows, best.ids, best.scores), strict=True))))
        return pa.concat_tables(out)

    left = groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = buckets.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(max(n_groups, 1) - 1))))
    return left.groupBy("group", "slice").cogroup(right.groupBy("group", "slice")).applyInArrow(run, ", ".join(f"{c} long" for c in columns))


def mine(vectors: DataFrame, anchors_where: str = "vec_id % 100 = 0") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    vectors: vec_id, embedding, label. anchors_where: a condition on vec_id that says which rows are anchors. An anchor's positives are its first POSITIVES other rows of its label; a
    negative has another label and a score of LOW to HIGH percent of the positive's; a window without such a row gives none.
    """
    rows = stage(_prepared(vectors), "vectors")
    anchors = rows.where(anchors_where)
    buckets, slices = _buckets(rows, rows.count())
    groups, n_groups = _groups(anchors.withColumn("score", F.lit(0).cast("long")), anchors.count())
    near = _grid(groups, n_groups, buckets, slices, best_positives)
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= POSITIVES)
    near = stage(near.select("anchor", F.col("row").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # positives with equal scores have equal windows
    windows = near.select(F.col("anchor").alias("row"), F.col("positive_score").alias("score")).distinct().join(anchors, "row")
    groups, n_groups = _groups(windows, POSITIVES * anchors.count())
    found = _grid(groups, n_groups, buckets, slices, best_negatives)
    first = Window.partitionBy("anchor", "positive_score").orderBy(F.desc("score"), "vec_id", "row")
    found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= NEGATIVES)
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return (
        found.select("anchor", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(near, ["anchor", "positive_score"])
        .join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
        .select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")
    )
