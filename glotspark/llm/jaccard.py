"""Exact n-gram Jaccard join with set-relation skipping.

A document's set is its distinct word shingles. Two documents link when
``100 * intersection >= percent * union``. The index keeps, for each shingle, the list of
sets that hold it in their prefix (with size and position); shingles are ordered by how
common they are, so that passages which many documents share come last. Two sets that link
share a shingle of their prefixes, so the lists miss nothing.

Set relations are used throughout. Equal sets are one entry: only one document of each class
of equal sets is indexed. Each list's entries are first compared with the list's pivot only
(the entry with the fewest rarer shingles), and the overlaps found are kept. The answers of a
set that is linked hold for all that its component holds: pairs within a component are never
compared again. For a pair across components the pivot's answers tell how much two sets can
share: no more than one shares with the pivot and the other has beside the pivot; what can't
reach the threshold by that is left out. The rest of a list is cut into blocks by size class;
an entry's position says up to which size a partner can reach the threshold, and blocks beyond
that, or below the smallest possible size, are skipped whole. A pair is left out of lists where
both sets have the same shingle before (an earlier list has it), and only what then remains is
verified, exactly.

Shingles are 64-bit hashes (see ``tokens``). The order of shingles comes from counts over
all documents; it decides the work, never the result.

Defined results: null or empty texts have no shingles and link with nothing; a text of fewer
words than a shingle has one shingle, its whole sequence; rows that share an id are one
document, whose component is that of all its texts; a row with a null id links nothing and
has a null component; repeated rows repeat; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .components import components
from .shared import Scratch, saved

#: A shingle is common when this share of the documents holds it; at most COMMON_MOST are told apart.
COMMON_SHARE, COMMON_MOST = 1 / 500, 1 << 17
#: Shingles that a Python worker counts at once, and those that it hands on at once.
HELD, SENT = 1 << 20, 1 << 18
#: Classes of equal sets that a Python worker remembers, so as not to hand them on again.
MET = 10_000
#: Documents are picked by a bitmap of their hashes (at most 32 MB) up to so many, by a join beyond.
PICKED = 1 << 24


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes (with repeats) and each document's first one."""
    starts, ends, first = tokens.words(data, offsets, tokens.NONSPACE)
    w = tokens.hashes(data, starts, ends)
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    edges = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(edges[-1]) - np.repeat(edges[:-1] - first[:-1], count)
    left = np.repeat(np.minimum(n, width), count)
    out = left.astype(np.uint64)
    last = max(0, len(w) - 1)
    for k in range(width):
        out = tokens.mix(out * tokens.U(0x9E3779B97F4A7C15) + np.where(k < left, w[np.minimum(at + k, last)] if len(w) else tokens.U(0), tokens.U(0)))
    return out, edges


def _sets(batch: pa.RecordBatch, width: int, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingles of each row (of those ``wanted``)."""
    data, offsets = tokens.buffers(batch.column(batch.schema.get_field_index("text")))
    for i, j in tokens.slices(offsets):
        if wanted is not None and not wanted[i:j].any():
            continue
        s, edges = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
        for k in range(i, j):
            if wanted is None or wanted[k]:
                yield k, np.unique(s[edges[k - i] : edges[k - i + 1]])


def common(docs: DataFrame, width: int) -> np.ndarray:
    """The common shingles, rarest first; bounded by COMMON_MOST (1 MB)."""

    def counted_in(held: list[np.ndarray]) -> pa.RecordBatch:
        s, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(s[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["s", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, s in _sets(batch, width):
                held.append(s)
                size += len(s)
                if size > HELD:
                    yield counted_in(held)
                    held, size = [], 0
        if held:
            yield counted_in(held)

    total = docs.count()
    counted = docs.select("text").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= max(2, math.ceil(total * COMMON_SHARE))).orderBy(F.desc("n"), "s").limit(COMMON_MOST).toPandas()
    return rows["s"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def keys(s: np.ndarray, salt: int) -> tuple[np.int64, np.int64]:
    """Two keys of a set: sums of differently mixed shingles."""
    one, two = tokens.mix(s ^ tokens.U(salt)), tokens.mix(s ^ tokens.U(0xA5A5A5A55A5A5A5A + salt))
    return tokens.mix(one.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0], two.sum(dtype=np.uint64).view(np.int64)


def sketch(s: np.ndarray) -> bytes:
    """Counts of a set's hashes in 2**k equal ranges, about 4 to 8 in each: k, then a byte each, 255 for more."""
    k = max(3, (len(s) >> 3).bit_length())
    return bytes([k]) + np.minimum(np.bincount((s >> tokens.U(64 - k)).astype(np.int64), minlength=1 << k), 255).astype(np.uint8).tobytes()


def most_shared(a: bytes, b: bytes) -> float:
    """An upper bound of two sets' intersection, from their sketches."""
    x, y = np.frombuffer(a, np.uint8, offset=1), np.frombuffer(b, np.uint8, offset=1)
    if (x.max(initial=0) == 255) or (y.max(initial=0) == 255):
        return math.inf
    x, y = x.astype(np.int64), y.astype(np.int64)
    m = min(len(x), len(y))
    return float(np.minimum(x.reshape(m, -1).sum(axis=1), y.reshape(m, -1).sum(axis=1)).sum())


def described(docs: DataFrame, width: int, salt: int) -> DataFrame:
    """doc, the set's size n, its two keys and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            drawn: list[bytes | None] = [None] * batch.num_rows
            for k, s in _sets(batch, width):
                n[k] = len(s)
                if len(s):
                    one[k], two[k] = keys(s, salt)
                    drawn[k] = sketch(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(one), pa.array(two), pa.array(drawn, pa.binary())], names=["doc", "n", "k1", "k2", "sketch"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, n long, k1 long, k2 long, sketch binary")


class Picked:
    """``rows`` (text, p) of at least the documents ``chosen`` (doc); ``mask`` says of a batch which rows to look at."""

    def __init__(self, docs: DataFrame, chosen: DataFrame):
        n = chosen.count()
        self.shared = None
        if n > PICKED:
            self.rows = docs.join(chosen, "doc", "left_semi").select("text", F.lit(0).cast("long").alias("p"))
            return
        bits = 1 << min(28, max(20, (16 * n).bit_length()))
        place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
        parts = chosen.select((place(F.col("doc")) + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
        bitmap = np.zeros(bits // 8, np.uint8)
        for r in parts:
            own = np.frombuffer(r.bits, np.uint8)
            bitmap[(r.bucket - 1) * 4096 :][: len(own)] = own
        self.shared = docs.sparkSession.sparkContext.broadcast(bitmap)
        self.rows = docs.select("text", place(F.col("doc")).alias("p"))

    @staticmethod
    def mask(shared, batch: pa.RecordBatch) -> np.ndarray | None:
        if shared is None:
            return None
        p = batch.column(1).to_numpy()
        return (shared.value[p >> 3] >> (p & 7) & 1).astype(bool)


def prefixes(chosen: Picked, width: int, percent: int, salt: int, order: np.ndarray) -> DataFrame:
    """For each document (each class of equal sets once a slice of the table) its set's key, the set's size, and its prefix in the shared order, each shingle with the one before it."""
    shared, wanted = chosen.rows.sparkSession.sparkContext.broadcast((np.sort(order), np.argsort(order, kind="stable"))), chosen.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, place = shared.value

        def row(node: list, n: list, kept: list) -> pa.RecordBatch:
            edges = np.concatenate([[0], np.cumsum([len(p) for p in kept])]).astype(np.int32)
            s = np.concatenate(kept)
            pair = pa.StructArray.from_arrays([pa.array(s), pa.array(np.concatenate([s[:1], s[:-1]]))], names=["s", "prev"])
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(edges), pair)], names=["node", "n", "prefix"])

        node, n, kept, size, met = [], [], [], 0, set()
        for batch in batches:
            if len(met) > MET:
                met.clear()
            for _, s in _sets(batch, width, Picked.mask(wanted, batch)):
                key = keys(s, salt)[0] if len(s) else None
                if key is None or key in met:
                    continue
                met.add(key)
                node.append(key)
                n.append(len(s))
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    late = frequent[at] == s
                    s = np.concatenate([s[~late], s[late][np.argsort(place[at[late]])]])
                kept.append(s[: prefix_length(n[-1], percent)].copy().view(np.int64))
                size += len(kept[-1])
                if size > SENT:
                    yield row(node, n, kept)
                    node, n, kept, size = [], [], [], 0
        if node:
            yield row(node, n, kept)

    return chosen.rows.mapInArrow(run, "node long, n int, prefix array<struct<s:long,prev:long>>")


def _can(percent: int) -> str:
    """Whether entries x and y of a list can belong to sets that link, from sizes and positions."""
    need = f"{percent} * (x.n + y.n)"
    return f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND {100 + percent} * least(x.n - x.pos, y.n - y.pos) >= {need}"


def _sets_of(chosen: Picked, width: int, salt: int) -> DataFrame:
    """(node, set) of the classes of at least the chosen documents."""
    wanted = chosen.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sets, size, met = [], [], 0, set()
        for batch in batches:
            if len(met) > MET:
                met.clear()
            for _, s in _sets(batch, width, Picked.mask(wanted, batch)):
                key = keys(s, salt)[0] if len(s) else None
                if key is None or key in met:
                    continue
                met.add(key)
                nodes.append(key)
                sets.append(s.view(np.int64))
                size += len(s)
                if size > SENT:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])
                    nodes, sets, size = [], [], 0
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return chosen.rows.mapInArrow(run, "node long, set array<long>")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Without those of ``pairs`` (a, b) whose sketches rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(100 + percent) * most_shared(x, y) >= percent * n for n, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    left, right = classes.select(F.col("k1").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("x")), classes.select(F.col("k1").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("y"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", F.expr("n_a + n_b AS n"), "x", "y")
    return rows.mapInArrow(run, "a long, b long")


def _overlaps(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int, salt: int) -> DataFrame:
    """(a, b, o, linked) of those of ``pairs`` (a, b) that sketches don't rule out: how many shingles they share, counted exactly."""
    scratch = Scratch(docs.sparkSession)
    pairs = scratch.saved(_possible(pairs, classes, percent), "jaccard-possible")
    chosen = pairs.selectExpr("explode(array(a, b)) AS k1").distinct().join(classes.select("k1", "doc"), "k1").select("doc")
    sets = scratch.saved(_sets_of(Picked(docs, chosen), width, salt), "jaccard-verify")
    both = F.size(F.array_intersect("set_a", "set_b"))
    rows = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", both.alias("o"), (F.size("set_a") + F.size("set_b")).alias("n"))
    out = saved(rows.select("a", "b", "o", F.expr(f"{100 + percent} * o >= {percent} * n").alias("linked")).distinct(), "jaccard-links")
    scratch.remove()
    return out


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``."""
    docs = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession)
    salt = 0
    while True:  # until no two sets share the first key
        rows = saved(described(docs, width, salt), "jaccard-rows")
        live = rows.where("n > 0 AND doc IS NOT NULL")
        classes = saved(live.groupBy("k1").agg(F.min("doc").alias("doc"), (F.min("k2") != F.max("k2")).alias("clash"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "jaccard-classes")
        if classes.where("clash").isEmpty():
            break
        salt += 1
    docs = docs.where("doc IS NOT NULL")
    indexed = prefixes(Picked(docs, classes.select("doc").distinct()), width, percent, salt, common(docs, width))
    entries = indexed.select("node", "n", F.posexplode("prefix").alias("pos", "at")).select("node", "n", "pos", "at.s", "at.prev")
    entries = entries.repartition("s").dropDuplicates(["s", "node"])
    # The pivot is the entry with the fewest rarer shingles before it: of near copies, the least edited. Ties go by a hash.
    entries = entries.withColumn("rank", F.shiftleft(F.col("pos").cast("long"), 32) + F.xxhash64("node").bitwiseAND(F.lit((1 << 32) - 1)))
    # Both sides of the join read one exchange, so both ask for the same columns.
    held = entries.groupBy("s").agg(F.max("prev").alias("p_prev"), F.count("*").alias("held"), F.min_by("node", "rank").alias("p_node"), F.min_by("n", "rank").alias("p_n"), F.shiftright(F.min("rank"), 32).cast("int").alias("p_pos")).where("held > 1")
    lists = scratch.saved(entries.drop("rank").join(held, "s"), "jaccard-lists")
    star = lists.selectExpr("struct(node, n, pos) AS x", "struct(p_node AS node, p_n AS n, p_pos AS pos) AS y").where(f"x.node <> y.node AND {_can(percent)}")
    first = saved(star.select(F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b")).distinct(), "jaccard-pairs")
    overlaps = _overlaps(first, docs, classes, width, percent, salt)
    links = overlaps.where("linked").select("a", "b")
    least = live.groupBy("doc").agg(F.min("k1").alias("a"), F.max("k1").alias("z")).where("a < z").select("doc", "a")
    own = live.join(least, "doc").select("a", F.col("k1").alias("b")).where("a < b").distinct()
    known = saved(components(links.union(own)), "jaccard-components")
    # What the pivots left open: entries of one list (of three or more) in different components.
    placed = lists.where("held > 2").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = scratch.saved(placed.select("s", "prev", "node", "n", "pos", "p_node", "component"), "jaccard-placed")
    mixed = placed.groupBy("s").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("s")
    # With the pivot's answers: how many shingles an entry shares with it, where that was counted.
    answers = overlaps.select(F.col("a").alias("node"), F.col("b").alias("p_node"), "o").union(overlaps.select("b", "a", "o"))
    told = placed.join(mixed, "s", "left_semi").join(answers, ["node", "p_node"], "left").withColumn("o", F.when(F.col("node") == F.col("p_node"), F.col("n")).otherwise(F.col("o")))
    step = math.log(100 / percent) / 4
    class_ = lambda n: F.floor(F.log(n.cast("double")) / step)
    blocked = scratch.saved(told.withColumn("block", class_(F.col("n"))), "jaccard-blocks")
    # y meets blocks of its own size class and below, down to the smallest partner that could link, and up to the largest that its position allows.
    smallest = F.ceil(F.col("n") * percent / 100)
    largest = F.least(F.col("n"), F.floor((100 + percent) * (F.col("n") - F.col("pos")) / percent) - F.col("n"))
    right = blocked.where(largest >= smallest).withColumn("block", F.explode(F.sequence(class_(smallest), class_(largest))))
    # A pair belongs to the list of the first shingle its prefixes share: not to one where both have the same shingle before.
    condition = f"x.s = y.s AND x.block = y.block AND x.component <> y.component AND (x.pos = 0 OR y.pos = 0 OR x.prev <> y.prev) AND (x.n < y.n OR x.n = y.n AND x.node < y.node) AND {_can(percent)}"
    # Two sets share no more than one does with the pivot and the other has beside the pivot.
    bound = f"(x.o IS NULL OR y.o IS NULL OR {100 + percent} * least(x.o + y.n - y.o, y.o + x.n - x.o) >= {percent} * (x.n + y.n))"
    pairs = blocked.alias("x").join(right.alias("y"), F.expr(f"{condition} AND {bound}")).select(F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b")).distinct()
    rest = saved(pairs.join(first, ["a", "b"], "left_anti"), "jaccard-rest")
    more = _overlaps(rest, docs, classes, width, percent, salt).where("linked").select("a", "b")
    if not more.isEmpty():
        # The components so far are stars of links; the new links join them.
        known = saved(components(more.union(known.toDF("a", "b"))), "jaccard-components")
    named = classes.join(known, F.col("k1") == F.col("node"), "left").select("k1", "doc", F.coalesce("component", "k1").alias("component"))
    named = saved(named, "jaccard-named")
    scratch.remove()
    smallest = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    member = named.join(smallest, "component").select("k1", "component_id")
    out = rows.alias("r").join(member.alias("c"), F.expr("r.k1 = c.k1 AND r.n > 0 AND r.doc IS NOT NULL"), "left")
    return out.select(F.col("r.doc").alias(key), F.col("r.n").alias("n_shingles"), F.coalesce(F.col("c.component_id"), F.col("r.doc")).alias("component_id"))
