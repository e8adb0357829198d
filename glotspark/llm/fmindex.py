"""Benchmark decontamination with an FM-index for each training shard.

The benchmark's windows (``window`` consecutive words of an item, or the whole of a shorter
item) are the patterns. Executors tokenise their documents into shards, and index each
shard: suffix array by prefix doubling, Burrows-Wheeler transform, wavelet matrix for ranks.
All patterns are backward-searched at once; occurrences are located by walking to sampled
suffix positions and merged into removal spans. A run of document words outside the
benchmark's vocabulary, or shorter than the shortest window, can't hold an occurrence: a
shard leaves such words out of its index, which changes no result.

Documents never shuffle. The benchmark is broadcast in blocks of at most ``BLOCK_CHARS``
characters (or one item); with several blocks, each is searched and spans are united.

Defined results: null or empty texts have no words and no hits; items without words have
no window; null item ids take part but aren't listed; repeated rows repeat; input columns
named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens

WINDOW = 10
BLOCK_CHARS = 4_000_000
#: An index and what builds it take some 20 times a shard's bytes.
SHARD_BYTES = 1 << 20
SAMPLE = 16
_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_WORD = T.StructType([T.StructField("at", T.IntegerType()), *_SPAN.fields])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(_SPAN))])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text``, whose zeros end runs: each zero is a symbol of its own, ordered by position."""
    n = len(text)
    ends = text == 0
    rank = text.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    low = rank[order]
    group = np.concatenate([[True], low[1:] != low[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(group, np.arange(n), 0))
    while True:
        tied = ~(group & np.concatenate([group[1:], [True]]))
        rows = np.flatnonzero(tied)  # rows of groups that aren't single yet
        if not len(rows):
            return order
        at = order[rows]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        sort = np.lexsort((after, rank[at]))
        at, head, after = at[sort], rank[at][sort], after[sort]
        order[rows] = at
        new = np.concatenate([[True], (head[1:] != head[:-1]) | (after[1:] != after[:-1])])
        group[rows] = new
        rank[at] = np.maximum.accumulate(np.where(new, rows, 0))
        step *= 2


class FMIndex:
    """Over symbols 1.. with zeros between runs; the first symbol of each run follows a zero."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        n = len(text)
        order = suffix_array(text)
        self.bwt = np.where(order > 0, text[order - 1], 0)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        starts = np.concatenate([[True], text[:-1] == 0])
        run = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        sampled = ((np.arange(n) - run) % SAMPLE == 0)[order]
        self.sample = np.where(sampled, order, -1)
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros, level = [], [], self.bwt
        path = np.zeros(n_symbols, np.int64)
        for k in reversed(range(self.bits)):
            bit = (level >> k) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = n - int(ones[-1])
            self.ones.append(ones)
            self.zeros.append(zeros)
            own = (np.arange(n_symbols) >> k) & 1
            path = np.where(own == 1, zeros + ones[path], path - ones[path])
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.path = path

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` is among the first ``i`` of the transform."""
        for k, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            o = ones[i]
            i = np.where((symbol >> k) & 1 == 1, zeros + o, i - o)
        return i - self.path[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of ``patterns`` that occur, and their ranges of suffixes."""
        which = np.arange(len(patterns))
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        for k in reversed(range(patterns.shape[1])):
            c = patterns[which, k]
            low, high = self.before[c] + self.rank(c, low), self.before[c] + self.rank(c, high)
            live = low < high
            which, low, high = which[live], low[live], high[live]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in ``rows``."""
        out, todo, steps = self.sample[rows], np.flatnonzero(self.sample[rows] < 0), 0
        while len(todo):
            c = self.bwt[rows[todo]]
            rows = rows.copy() if not steps else rows
            rows[todo] = self.before[c] + self.rank(c, rows[todo])
            steps += 1
            found = self.sample[rows[todo]]
            out[todo] = np.where(found >= 0, found + steps, -1)
            todo = todo[found < 0]
        return out


def expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All values of the ranges, and the range that each is of."""
    n = high - low
    own = np.repeat(np.arange(len(n)), n)
    return np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + low[own], own


class Patterns:
    """Windows of benchmark items over numbered words. Built on the driver from one block of items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        data, offsets = tokens.buffers(pa.array([t for _, t in items], pa.large_string()))
        starts, ends, first = tokens.words(data, offsets, tokens.ALNUM)
        words = tokens.hashes(data, starts, ends)
        self.names = [i for i, _ in items]
        self.vocabulary, numbers = np.unique(words, return_inverse=True)
        numbers = numbers + 1
        by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            if n := min(window, int(b - a)):
                made = np.lib.stride_tricks.sliding_window_view(numbers[a:b], n)
                by_length.setdefault(n, []).append((made, np.full(len(made), k)))
        self.by_length = {}
        for n, parts in by_length.items():
            found, of = np.unique(np.concatenate([p for p, _ in parts]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([of.reshape(-1), np.concatenate([k for _, k in parts])]), axis=1)
            self.by_length[n] = found, pairs[1], np.searchsorted(pairs[0], np.arange(len(found) + 1))
        self.shortest = min(self.by_length, default=0)

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Over one shard: whether each word is hit, and the (document, item) pairs found."""
        n, none = len(hashes), np.zeros(0, np.int64)
        number = self.numbered(hashes)
        number_docs = len(first) - 1
        known = number > 0
        start = known.copy()
        start[1:] &= ~known[:-1]
        edge = first[:-1]
        edge = edge[edge < n]
        start[edge] = known[edge]
        begins = np.flatnonzero(start)
        run = np.cumsum(start)[known] - 1
        size = np.bincount(run, minlength=len(begins))
        begins, size = begins[size >= self.shortest], size[size >= self.shortest]
        hit = np.zeros(n, bool)
        if not self.shortest or not len(begins):
            return hit, none, none
        origin, own = expand(begins, begins + size + 1)  # one more each for the zero after a run
        last = np.cumsum(size + 1) - 1
        text = number[np.minimum(origin, n - 1)]
        text[last] = 0
        index = FMIndex(text, len(self.vocabulary) + 1)
        edges, docs, items = np.zeros(n + 1, np.int64), [none], [none]
        of = np.repeat(np.arange(number_docs), np.diff(first))
        for length, (patterns, item, bound) in self.by_length.items():
            which, low, high = index.search(patterns)
            rows, own = expand(low, high)
            at = origin[index.locate(rows)]
            np.add.at(edges, at, 1)
            np.add.at(edges, at + length, -1)
            pairs = np.unique(np.stack([of[at], which[own]]), axis=1)
            entry, back = expand(bound[pairs[1]], bound[pairs[1] + 1])
            docs.append(pairs[0][back])
            items.append(item[entry])
        return np.cumsum(edges[:-1]) > 0, np.concatenate(docs), np.concatenate(items)


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids as text, sorted) and spans (code points, end exclusive, merged)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    out = docs.drop(*FOUND.names)
    for k in range(blocks):
        block = [(r.item, r.text) for r in dealt.where(F.col("block") == k).collect()]
        out = _search(out, Patterns(block, window), text, "__found" if blocks == 1 else f"__found_{k}")
    if blocks > 1:
        out = out.withColumn("__found", _united([F.col(f"__found_{k}") for k in range(blocks)]))
    return out.select(*docs.drop(*FOUND.names).columns, *(F.col("__found")[c].alias(c) for c in FOUND.names))


def _united(found: list) -> F.Column:
    """Finds of several blocks over the same words: ``spans`` of single words make the union exact."""
    words = F.array_sort(F.array_distinct(F.flatten(F.array(*(f["words"] for f in found)))))
    spans = F.aggregate(
        words,
        F.array().cast("array<struct<start:int,end:int,next:int>>"),
        lambda acc, w: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["next"] == w["at"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), w["end"].alias("end"), (w["at"] + 1).alias("next"))))).otherwise(
            F.concat(acc, F.array(F.struct(w["start"].alias("start"), w["end"].alias("end"), (w["at"] + 1).alias("next"))))
        ),
    )
    return F.struct(
        found[0]["n_words"].alias("n_words"),
        F.size(words).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*(f["items"] for f in found))))).alias("items"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"),
    )


def _search(docs: DataFrame, patterns: Patterns, text: str, name: str) -> DataFrame:
    single = name == "__found"
    kind = T.StructType([*FOUND.fields] if single else [*FOUND.fields, T.StructField("words", T.ArrayType(_WORD))])
    shared = docs.sparkSession.sparkContext.broadcast(patterns)
    pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    triple = pa.struct([("at", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            data, offsets = tokens.buffers(batch.column(batch.schema.get_field_index(text)))
            n_words, n_hit = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            items: list[list] = [[] for _ in range(batch.num_rows)]
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            singles: list[list] = [[] for _ in range(batch.num_rows)]
            for i, j in tokens.slices(offsets, SHARD_BYTES):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = tokens.words(part, off, tokens.ALNUM)
                n_words[i:j] = np.diff(first)
                hit, doc, item = p.hits(tokens.hashes(part, starts, ends), first)
                n_hit[i:j] = tokens.grouped_sum(hit, first)
                for d, k in zip((doc + i).tolist(), item.tolist(), strict=True):
                    if p.names[k] is not None:
                        items[d].append(p.names[k])
                at = np.flatnonzero(hit)
                if len(at):
                    of = np.searchsorted(first, at, "right") - 1
                    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])])
                    final = np.concatenate([new[1:], [True]])
                    heads = np.flatnonzero((part & 0xC0) != 0x80)
                    zero = np.searchsorted(heads, off)
                    a, b = np.searchsorted(heads, starts[at]) - zero[of], np.searchsorted(heads, ends[at]) - zero[of]
                    for d, x, y in zip((of[new] + i).tolist(), a[new].tolist(), b[final].tolist(), strict=True):
                        spans[d].append({"start": x, "end": y})
                    if not single:
                        for d, w, x, y in zip((of + i).tolist(), (at - first[of]).tolist(), a.tolist(), b.tolist(), strict=True):
                            singles[d].append({"at": w, "start": x, "end": y})
            columns = [pa.array(n_words), pa.array(n_hit), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pair))]
            names = list(FOUND.names)
            if not single:
                columns.append(pa.array(singles, pa.list_(triple)))
                names.append("words")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(columns, names=names)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def without_spans(text: F.Column, spans: F.Column) -> F.Column:
    """``text`` with the spans cut out."""
    cut = F.aggregate(
        spans,
        F.struct(F.lit("").alias("kept"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(F.concat(acc["kept"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])).alias("kept"), s["end"].alias("at")),
        lambda acc: F.concat(acc["kept"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, cut).otherwise(text)


