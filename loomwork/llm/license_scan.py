"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

A template of t distinct shingles (five words each) belongs to the size class S, the least power of two with t <= S. A
document is cut into windows of 2S shingles, one every S, so whatever stands in S shingles in a row
lies in one window as a whole. A window that has `percent` of a template's shingles has some least
Jaccard similarity with it (0.19 at 80 percent, for t just over S / 2). A class has as many bands of one row as bring the chance
that such a pair collides in none to MISS at most; that are 66 bands for the least similar templates. Minima of blocks of S shingles are reused
for all windows and, by doubling, for all classes.

All documents of a batch are hashed and looked up at once: a table of the low 16 bits tells for each band which minima could be a
template's, and only those are searched for. A retrieved template matches where the window holds at
least `percent` of its distinct shingles, counted exactly. Of templates of different licenses that share half of their
shingles and match in overlapping windows the one with the larger containment is reported, of equal ones the
larger template, then the one of the lesser name (so a text with three BSD clauses isn't also one with two). Templates go to every task;
more than MOST_TEMPLATES are refused.

Defined cases: null and empty texts have no words; a document shorter than a shingle has none; a template of
fewer words than a shingle raises ValueError; rows that repeat are scanned each; very long texts are scanned whole, each in one
piece; of windows of equal containment the first is reported; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import pick
from loomwork.llm.license_texts import catalogue

SHINGLE, MISS, PERCENT = 5, 1e-6, 80
MOST_TEMPLATES = 5000  #: they go to every task
AT_ONCE = 16_000  #: shingles that are looked up at once, or one document
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def _hashes(texts: list[bytes], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n): the 64-bit hashes of all texts' shingles in order, and how many each text has."""
    words = [WORD.findall(t.lower()) for t in texts]
    if len(known) > 400_000:
        known.clear()
    for w in set().union(*words).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    n = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((known[w] for row in words for w in row), np.uint64, int(n.sum()))
    if len(flat) < SHINGLE:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    out = flat[: len(flat) - SHINGLE + 1].copy()
    for i in range(1, SHINGLE):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + flat[i : len(flat) - SHINGLE + 1 + i]
    ends = np.repeat(np.cumsum(n), n)[: len(out)]
    return (out ^ (out >> np.uint64(32)))[np.arange(len(out)) + SHINGLE <= ends], np.maximum(n - SHINGLE + 1, 0)


class Matcher:
    """Templates by size class, with the values that each band has for them."""

    def __init__(self, templates: list[tuple[str, str]], percent: int):
        self.percent, self.names, self.sets, runs = percent, [], [], []
        for name, text in templates:
            run = _hashes([text.encode()], {})[0]
            s = np.unique(run)
            runs.append(len(run))
            if not len(s):
                raise ValueError(f"a template of {name} has fewer than {SHINGLE} words")
            self.names.append(name)
            self.sets.append(s)
        of: dict[int, list[int]] = defaultdict(list)
        for k, n in enumerate(runs):  # repeated shingles count: a window has to hold the whole text
            of[1 << (n - 1).bit_length()].append(k)
        need = {k: -(-percent * len(s) // 100) for k, s in enumerate(self.sets)}
        self.least = {size: min(need[k] for k in own) for size, own in of.items()}
        self.bands = {size: max(math.ceil(math.log(MISS) / math.log(1 - need[k] / (2 * size + len(self.sets[k]) - need[k]))) for k in own) for size, own in of.items()}
        #: Odd multipliers of the MinHash functions, from a fixed seed.
        self.factors = np.random.default_rng(20).integers(0, 1 << 62, max(self.bands.values(), default=1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.classes = {}
        for size, own in sorted(of.items()):
            minima = np.stack([self.permuted(self.sets[k], self.bands[size]).min(1) for k in own], 1)  # a row for each band
            tables = []
            for row in minima:
                table = np.zeros(1 << 16, bool)
                table[row & 0xFFFF] = True
                order = np.argsort(row, kind="stable")
                tables.append((table, row[order], np.array(own)[order]))
            self.classes[size] = tables
        self.rivals = self._rivals()

    def permuted(self, hashes: np.ndarray, bands: int) -> np.ndarray:
        """A row for each hash function: the upper half of a product."""
        return ((hashes[None, :] * self.factors[:bands, None]) >> np.uint64(32)).astype(np.uint32)

    def _rivals(self) -> dict[int, set[int]]:
        """For each template those of other licenses that have half of its shingles."""
        holders: dict[int, list[int]] = defaultdict(list)
        for k, s in enumerate(self.sets):
            for v in s.tolist():
                holders[v].append(k)
        shared: dict[int, Counter] = defaultdict(Counter)
        for own in holders.values():
            for k in own:
                shared[k].update(own)
        return {k: {m for m, n in row.items() if 2 * n >= len(self.sets[k]) and self.names[m] != self.names[k]} for k, row in shared.items()}

    def retrieved(self, hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, set[tuple[int, int, int, int]]]:
        """(windows of each document, {(document, template, first shingle, end)}): what collides in a band, shingles counted over all documents."""
        ends = np.cumsum(n)
        windows, found = np.zeros(len(n), np.int64), set()
        blocks, docs, width = None, np.flatnonzero(n > 0), 1
        for size, tables in self.classes.items():
            docs = docs[n[docs] >= self.least[size]]  # a shorter one can't hold enough of any template of this class or a larger one
            if not len(docs):
                break
            if blocks is None:
                blocks = self.permuted(hashes, len(self.factors))
                first, count = ends - n, n.copy()
            while width < size:  # minima of two neighbours; the last may stand alone
                own = np.repeat(np.arange(len(docs)), (count[docs] + 1) // 2)
                starts = np.cumsum((count[docs] + 1) // 2) - (count[docs] + 1) // 2
                left = first[docs][own] + 2 * (np.arange(len(own)) - starts[own])
                right = np.minimum(left + 1, (first + count)[docs][own] - 1)
                blocks, width = np.minimum(blocks.take(left, 1), blocks.take(right, 1)), width * 2
                first, count = first.copy(), count.copy()
                first[docs], count[docs] = starts, (count[docs] + 1) // 2
            many = np.maximum(count[docs] - 1, 1)
            own = np.repeat(np.arange(len(docs)), many)
            place = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
            left = first[docs][own] + place
            right = np.minimum(left + 1, (first + count)[docs][own] - 1)
            windows[docs] += many
            for band, (table, values, templates) in enumerate(tables):
                least = np.minimum(blocks[band].take(left), blocks[band].take(right))
                for at in np.flatnonzero(table.take(least & 0xFFFF)).tolist():
                    a, b = np.searchsorted(values, least[at]), np.searchsorted(values, least[at], "right")
                    doc = int(docs[own[at]])
                    start = int(ends[doc] - n[doc]) + int(place[at]) * size
                    found.update((doc, k, start, min(start + 2 * size, int(ends[doc]))) for k in templates[a:b].tolist())
        return windows, found

    def scan(self, hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[list[tuple[str, float, int, int]]]]:
        """For each document the number of windows, and (license, containment, first shingle, end) of what it holds."""
        windows, found = self.retrieved(hashes, n)
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in n]
        first = np.cumsum(n) - n
        for doc, k, a, b in sorted(found):
            s = self.sets[k]
            common = len(np.intersect1d(np.unique(hashes[a:b]), s, assume_unique=True))
            if 100 * common >= self.percent * len(s) and common / len(s) > best[doc].get(k, (0.0,))[0]:
                best[doc][k] = (common / len(s), a - int(first[doc]), b - int(first[doc]))

        def beaten(k: int, own: dict[int, tuple[float, int, int]]) -> bool:
            rank = lambda m: (own[m][0], len(self.sets[m]), [-ord(c) for c in self.names[m]])
            return any(m in own and own[m][1] < own[k][2] and own[k][1] < own[m][2] and rank(m) > rank(k) for m in self.rivals[k])

        return windows, [sorted((self.names[k], *own[k]) for k in own if not beaten(k, own)) for own in best]


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, n_windows, n_templates, licenses, best, spans), one row for each row of docs.

    licenses: the names found, sorted, comma between; best: the largest containment (0.0: none); spans: of each
    template found (name, containment, start, end), in words. n_windows counts the windows that were long enough for a template.
    """
    flat = [(name, text) for name, texts in (catalogue() if templates is None else templates).items() for text in texts]
    if len(flat) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates: scan them in parts, a result for each")
    Matcher(flat, percent)  # refuses templates here, not in a task
    schema = "doc_id long, n_shingles long, n_windows long, spans array<struct<license:string,containment:double,start:long,end:long>>"
    kind = pa.struct([("license", pa.string()), ("containment", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes]]]:
        """Some documents at a time, with about AT_ONCE shingles by their bytes."""
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1)], np.int64) // 6
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes), (sizes[:at].sum()) + AT_ONCE)))
            rows = batch.slice(at, upto - at)
            yield rows.column(0), [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in rows.column(1)]
            at = upto

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, known = Matcher(flat, percent), {}  # made from the texts, which are much smaller than its tables
        for batch in batches:
            for ids, texts in parts(batch):
                hashes, n = _hashes(texts, known)
                windows, spans = matcher.scan(hashes, n)
                made = [{"license": x[0], "containment": x[1], "start": x[2], "end": x[3] + SHINGLE - 1} for row in spans for x in row]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in spans])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(windows), pa.ListArray.from_arrays(pa.array(offsets), pa.array(made, kind))], names=["doc_id", "n_shingles", "n_windows", "spans"])

    found = pick(docs, "doc_id", "text").mapInArrow(run, schema)
    names = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["license"])))
    return found.select(
        "doc_id", "n_shingles", "n_windows", F.size("spans").cast("long").alias("n_templates"), F.array_join(names, ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["containment"])), F.lit(0.0)).alias("best"), "spans",
    )
