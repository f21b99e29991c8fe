r"""Near duplicates: bottom-k sketches of one hash function, inverted lists, union-sketch estimates, exact Jaccard.

1. A document's set is the hashes of its distinct shingles. Documents of equal sets are one class; its
   representative is its least doc_id. The SKETCH least hashes of the set are its sketch.
2. Inverted lists are keyed by runs of neighbouring retained values: two sets of Jaccard similarity 0.8 or more share long runs of
   their sorted union, while unlike texts with a passage in common seldom share a run. Sets of
   4 or 5 shingles have runs of 2, up to 25 runs of 3, from 20 on runs of 4. Where the sketch is the whole set, the pigeonhole
   principle gives a shared run for every linked pair; beyond that, of SKETCH values of the union each is
   shared with a chance of at least 0.8, and no run of 4 comes with a chance of about 1e-6 at a
   similarity of exactly 0.8, less above.
3. First pairs: in each list, the least member with each other one. Estimates from the sketch of the union filter
   pairs, the whole sets then decide. This collapses groups of copies into components without all their pairs.
4. The rest: documents of lists whose members, the least one apart, lie in several components. They get inverted lists of
   single values, rare ones first: a linked pair differs in so few values that of a set of n the n - ceil(percent n / 100) + 1 rarest
   ones are enough to meet in, so a passage that many share brings its documents together only where it is nearly all of them.
   A value's place bounds what two sets can still have in common from there on; where the first common value's
   places don't allow the similarity, the pair is none. Each list's leader is the member that has the value earliest, and meets the
   others as in step 3; then lists of several components are compared in blocks of at most BLOCK members, many
   blocks in many tasks, and only pairs that pass become rows. Any order of values is exact, as long as it is one for all sets: only the
   frequencies of the MOST_KNOWN most frequent values at most are told apart, those of the others count as one.

Defined cases: documents without words (null or empty text) have an empty set and are linked with nothing; a row without doc_id is linked
with nothing and has a null component; rows that share a doc_id count as one document where that id represents
its class; fewer words than a shingle takes are one shingle; a very long text is one row's array of hashes; equal similarities
need no order, since all links count; an empty table gives no rows; columns are picked by exact name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import ascii_lower, numbered, pick, small, stage, unstage
from loomwork.llm.components import components

WORD = r"[^\x20\x09-\x0D]+"
SKETCH = 64
SLACK = 0.25  #: what an estimate may fall short of the threshold: 5 standard deviations at 64 values
BLOCK = 256  #: members of a block
SALT = 128  #: pairs of one document that a task gets at once
MOST_KNOWN = 250_000  #: values whose frequency goes to every task


def _ints(a: Column, b: Column) -> Column:
    return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def shingle_set(text: Column, shingle: int) -> Column:
    """The sorted distinct 64-bit hashes of a text's shingles; null and wordless texts have none."""
    words = F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))
    none = F.array().cast("array<bigint>")

    def of(w: Column) -> Column:
        many = F.transform(_ints(F.lit(0), F.size(w) - shingle), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(shingle)]))
        one = F.array(F.xxhash64(F.lit("fewer words"), F.array_join(w, " ")))
        return F.when(F.size(w) >= shingle, F.sort_array(F.array_distinct(many))).when(F.size(w) > 0, one).otherwise(none)

    # the words are named once, in a one-element array, so that they aren't split for each mention
    return F.coalesce(F.get(F.transform(F.array(words), of), F.lit(0)), none)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_md5, n, d1, d2, sketch): set size, 128-bit digest of the set, its SKETCH least hashes."""
    sets = pick(docs, "doc_id", "text").select("doc_id", F.md5("text").alias("text_md5"), shingle_set(F.col("text"), shingle).alias("set"))
    return sets.select("doc_id", "text_md5", F.size("set").alias("n"), F.xxhash64("set").alias("d1"), F.xxhash64(F.lit(1), F.reverse("set")).alias("d2"), F.slice("set", 1, SKETCH).alias("sketch"))


def list_keys(n: Column, sketch: Column) -> Column:
    """The keys of the inverted lists that a set is in."""

    def runs(depth: int, least: int, most: int | None) -> Column:
        keys = F.transform(_ints(F.lit(0), F.size(sketch) - depth), lambda i: F.xxhash64(*[F.get(sketch, i + j) for j in range(depth)]))
        fits = n >= least if most is None else n.between(least, most)
        return F.when(fits, keys).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(F.concat(runs(2, 4, 5), runs(3, 5, 25), runs(4, 20, None)))


def _with(pairs: DataFrame, x: str, side: DataFrame) -> DataFrame:
    """pairs with the columns of side (keyed by x); a document of many pairs is dealt to several tasks."""
    other = "b" if x == "a" else "a"
    hot = pairs.groupBy(x).agg(F.count("*").alias("n")).where(F.col("n") > SALT)
    hot = small(stage(hot.select(x, F.ceil(F.col("n") / SALT).cast("int").alias("parts")), "hot"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(hot, x, "left").withColumn("salt", F.pmod(F.xxhash64(other), parts).cast("int")).drop("parts")
    copied = side.join(hot, x, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(copied, [x, "salt"]).drop("salt")


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose similarity, estimated from the sketch of the union, isn't clearly too low; staged."""
    side = lambda x: reps.select(F.col("rid").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = _with(_with(pairs, "b", side("b")), "a", side("a"))
    least = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, SKETCH)
    common = F.size(F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), least))
    sized = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return stage(both.where(sized & (common >= (percent / 100 - SLACK) * F.size(least))).select("a", "b"), "pairs")


def _sets(ids: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """(rid, set): the whole sets of the representatives in ids (rid), staged."""
    wanted = stage(ids.join(reps.select("rid", "d1", "d2"), "rid").select(F.col("rid").alias("doc_id"), "d1", "d2"), "wanted")
    texts = pick(docs, "doc_id", "text").join(small(wanted), "doc_id")
    # staged before the filter, which would make each set again
    made = stage(texts.select(F.col("doc_id").alias("rid"), "d1", "d2", shingle_set(F.col("text"), shingle).alias("set")), "sets")
    unstage(wanted)
    # an id may have several texts, or one text more than once; a text of its class is meant
    own = made.where((F.xxhash64("set") == F.col("d1")) & (F.xxhash64(F.lit(1), F.reverse("set")) == F.col("d2")))
    if own.groupBy("rid", "d1", "d2").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():  # rows that repeat a representative
        own = stage(own.dropDuplicates(["rid", "d1", "d2"]), "sets")
    return own


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have at least the similarity, staged."""
    side = lambda x: sets.select(F.col("rid").alias(x), F.col("set").alias(f"set_{x}"))
    both = _with(_with(pairs, "b", side("b")), "a", side("a"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return stage(both.where(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select("a", "b").distinct(), "links")


def _linked(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    near = _estimated(pairs, reps, percent)
    links = _verified(near, sets, percent)
    unstage(near)
    return links


def _frequent(values: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(values, classes): the most frequent values, sorted, with the whole part of their count's binary logarithm; MOST_KNOWN at most.

    A class is taken with all its values or not at all.
    """
    counts = stage(values.groupBy("value").agg(F.floor(F.log2(F.count("*"))).cast("int").alias("class")).where("class > 0"), "counts")
    sizes = sorted(((r["class"], r["n"]) for r in counts.groupBy("class").agg(F.count("*").alias("n")).collect()), reverse=True)  # 63 rows at most
    least, total = 64, 0
    for kind, n in sizes:
        if (total := total + n) > MOST_KNOWN:
            break
        least = kind
    known = counts.where(F.col("class") >= least).toPandas().sort_values("value")
    unstage(counts)
    return known["value"].to_numpy(np.int64), known["class"].to_numpy(np.int64)


def _prefixes(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(value, rid, n, pos): of each set in rest (rid) the values that a linked one must meet it in, with their places, rare values first."""
    own = sets.join(small(rest.select("rid")), "rid").select("rid", "set")
    known, classes = _frequent(own.select(F.explode("set").alias("value")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(first, 1000) for whole in batches for first in range(0, whole.num_rows, 1000)):
            rid, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            values, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
            kind = np.zeros(len(values), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                kind = np.where(known[at] == values, classes[at], 0)
            order = np.lexsort((values, kind, row))  # the rows stay where they are
            pos = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            kept = pos < (n + (-percent * n) // 100 + 1)[row]
            yield pa.RecordBatch.from_arrays([pa.array(values[order][kept]), pa.array(rid[row][kept]), pa.array(n[row][kept]), pa.array(pos[kept])], names=["value", "rid", "n", "pos"])

    return own.mapInArrow(run, "value long, rid long, n long, pos long")


def _mixed(prefixes: DataFrame, comps: DataFrame) -> DataFrame:
    """prefixes with comp, of those values whose holders lie in several components; staged."""
    named = prefixes.join(small(comps.select(F.col("node").alias("rid"), "component")), "rid", "left")
    named = named.select("value", "rid", "n", "pos", F.coalesce("component", "rid").alias("comp"))
    shared = stage(named.groupBy("value").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("value"), "shared")
    out = stage(named.join(small(shared), "value"), "mixed")
    unstage(shared)
    return out


def _led(mixed: DataFrame, percent: int) -> DataFrame:
    """(a, b): each list's leader, which has the value earliest of all members, with those members that it may be linked with."""
    first = F.min(F.struct((F.col("pos") / F.col("n")).alias("share"), "rid", "n", "pos", "comp")).alias("lead")
    leaders = stage(mixed.groupBy("value").agg(first), "leaders")
    met = mixed.join(small(leaders), "value").where("comp <> lead.comp")
    need, left = percent * (F.col("n") + F.col("lead.n")), 100 + percent
    met = met.where((left * (F.col("n") - F.col("pos")) >= need) & (left * (F.col("lead.n") - F.col("lead.pos")) >= need))
    return met.select(F.least("rid", "lead.rid").alias("a"), F.greatest("rid", "lead.rid").alias("b")).distinct()


def _blocks(mixed: DataFrame) -> DataFrame:
    """mixed dealt to groups (value, i, j) of at most about two blocks of members, with each member's side.

    A list's largest component is its main one, whose members needn't meet each other: each of its blocks meets each block
    of the others (i is negative then), and the others' blocks meet each other. Only members of different sides are
    compared where i and j differ.
    """
    parts = mixed.groupBy("value", "comp").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("value").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("members"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.where(F.col("members") > 2 * BLOCK)  # the others are one group each
    sizes = stage(sizes.select("value", F.col("main.comp").alias("main"), blocks(F.col("main.n")).alias("mains"), blocks(F.col("members") - F.col("main.n")).alias("others")), "sizes")
    dealt = mixed.join(small(sizes), "value", "left")
    is_main = F.col("comp") == F.col("main")
    own = F.pmod(F.xxhash64("rid"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    group = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("own"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    whole = F.array(group(F.lit(0), F.lit(0), F.lit(0)))
    of_main = F.transform(upto("others"), lambda j: group(-1 - own, j, F.lit(0)))
    of_other = F.concat(
        F.transform(upto("mains"), lambda i: group(-1 - i, own, F.lit(1))), F.transform(upto("others"), lambda j: group(F.least(own, j), F.greatest(own, j), own))
    )
    groups = F.when(F.col("main").isNull(), whole).when(is_main, of_main).otherwise(of_other)
    return dealt.select("value", "rid", "n", "pos", "comp", F.explode(groups).alias("g")).select("value", "g.i", "g.j", "g.own", "rid", "comp", "n", "pos")


def _compared(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components within a group whose sizes and places allow the similarity."""

    def pairs(i: int, j: int, own: np.ndarray, rid: np.ndarray, comp: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        need, left = percent * (n[:, None] + n[None, :]), (100 + percent) * (n - pos)
        fits = (left[:, None] >= need) & (left[None, :] >= need) & (comp[:, None] != comp[None, :]) & (rid[:, None] < rid[None, :])
        if i != j:
            fits &= own[:, None] != own[None, :]
        a, b = np.nonzero(fits)
        return rid[a], rid[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, [], []

        def done() -> None:
            if held:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                if len(cols[0]) > 1:
                    found.append(pairs(key[1], key[2], *cols))
                held.clear()

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate([np.zeros(0, np.int64), *(f[x] for f in found)]) for x in (0, 1))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            value, i, j, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero((value[1:] != value[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(value)], strict=True):
                if first == end:
                    continue
                if (now := (value[first], i[first], j[first])) != key:
                    done()
                    key = now
                held.append([c[first:end].copy() for c in rest])
            yield out()
        done()
        yield out()

    return groups.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _rest_linked(rest: DataFrame, found: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The components found, (node, component), after step 4 over the documents in rest (rid)."""
    if rest.isEmpty():
        return found
    prefixes = stage(_prefixes(rest, sets, percent), "prefixes")
    for step in (lambda mixed: _led(mixed, percent), lambda mixed: _compared(_blocks(mixed), percent)):
        mixed = _mixed(prefixes, found)
        pairs = stage(step(mixed), "near")
        unstage(mixed)
        if not pairs.isEmpty() and not (links := _linked(pairs, reps, sets, percent)).isEmpty():
            found = components(links.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        unstage(pairs)
    unstage(prefixes)
    return found


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_md5), one row for each row of docs.

    Documents whose sets have 100 * intersection >= percent * union are linked; component_id is the least doc_id
    that links reach, and kept says that it is the document's own.
    """
    rows = stage(sketches(docs, shingle), "sketches")
    whole = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = whole.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rid"), F.count("*").alias("copies"))
    classes = stage(classes, "classes")
    # every class has a row of its representative; repeats of that row are dropped
    reps = whole.join(classes.where("copies > 1").select("n", "d1", "d2", "rid"), ["n", "d1", "d2"], "left")
    reps = reps.where(F.col("rid").isNull() | (F.col("rid") == F.col("doc_id"))).select(F.col("doc_id").alias("rid"), "n", "d1", "d2", "sketch")
    reps = stage(reps.dropDuplicates(["rid", "d1", "d2"]), "reps")

    postings = reps.where("n > 3").select(F.explode(list_keys(F.col("n"), F.col("sketch"))).alias("key"), "rid")
    lists = stage(postings.groupBy("key").agg(F.min("rid").alias("leader"), F.max("rid").alias("last")).where("leader < last").select("key", "leader"), "lists")
    members = stage(postings.join(small(lists), "key").where("rid <> leader").select("key", "leader", "rid"), "members")
    sets = _sets(members.select("rid").union(lists.select("leader")).distinct(), docs, reps, shingle)
    first = stage(members.select(F.col("leader").alias("a"), F.col("rid").alias("b")).distinct(), "first")
    links = _linked(first, reps, sets, percent)
    found = components(links)

    rest = members.select("key", "rid").join(small(found.select(F.col("node").alias("rid"), "component")), "rid", "left")
    rest = rest.select("key", "rid", F.coalesce("component", "rid").alias("comp"))
    several = stage(rest.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key"), "several")
    rest = stage(members.join(small(several), "key").select("rid").distinct(), "rest")
    unstage(lists, members, several, first)
    found = _rest_linked(rest, found, reps, sets, percent)
    unstage(sets, reps, rest)

    out = rows.join(small(classes.where("copies > 1").select("n", "d1", "d2", "rid")), ["n", "d1", "d2"], "left")
    out = out.withColumn("rid", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rid", "doc_id")).otherwise(F.col("doc_id")))
    out = out.join(small(found), F.col("rid") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "rid"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_md5")


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, with one document of each component; a row that repeats its document is dropped too."""
    result = near_duplicates(docs, shingle, percent).where("kept")
    kept = stage(result.groupBy("doc_id", "text_md5").agg(F.count("*").alias("copies")), "kept")
    plain, (doc_id, text) = numbered(docs, "doc_id", "text")

    def rows(which: str) -> DataFrame:
        ids = small(kept.where(which).select("doc_id", "text_md5"))
        return plain.join(ids, F.col(doc_id).eqNullSafe(F.col("doc_id")) & F.md5(text).eqNullSafe(F.col("text_md5")), "left_semi")

    return rows("copies = 1").union(rows("copies > 1").dropDuplicates([doc_id, text])).toDF(*docs.columns)
