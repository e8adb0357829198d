"""LM scoring with a Katz backoff bigram model, counted and evaluated where its counts lie.

Tokens are a text's lower-cased words and one end; the first token's context is a begin
mark. Counts come from all training documents. Counts up to K are discounted by Good-Turing
(see ``discounted``), larger bigram counts by TAIL, so that
every context leaves some mass. An unseen bigram backs off: P(w|h) = alpha(h) P(w), with
alpha(h) chosen so that P(.|h) sums to 1 over the vocabulary and one unknown word; with an
unseen context P(w|h) = P(w). As every word of a text is a context exactly once, log c(h)
is added up over words.

How it is spread out. Words and bigrams that make at least 1 in HOT of the training tokens
(so at most HOT of each) are counted first and their exact counts broadcast: a hot bigram
is evaluated where its text is read and never moves. Executors send each block's other
bigrams, packed (zstd arrays: words, contexts, documents; hot words as numbers of two bytes),
to a partition by the hash of the word, those of hot words by word and context. There all
counts of the word are at hand, c(w) and c(h, w). Partitions work through their words in parts
of at most PART_TOKENS tokens. They give back each token's counts, from which, with the
discounts that need the whole corpus, its probability is worked out order by order; and
statistics by context, which meet in partitions by context hash (a table in the shared folder)
for the backoff weights and the unseen bigrams; the begin mark and the WIDE most frequent
contexts are summed for all and broadcast instead. Texts never shuffle.

Words are 64-bit hashes (see ``tokens``). Defined results: null text is an empty text (one
end token); a null id is never held out; rows that repeat are documents of their own; with no
training rows all scores are 0; an empty table gives an empty result; other columns are left
out.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .fmindex import expand
from .shared import saved

K, TAIL, HOT, WIDE = 5, 0.1, 65_000, 512
BLOCK_BYTES, BUCKET_TOKENS, PART_TOKENS = 4 << 20, 3 << 19, 1 << 18
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
U = tokens.U
ROW = "kind string, part long, block long, payload binary"


def _by_bytes(kind: np.dtype) -> bool:
    return kind.itemsize > 1 and kind.kind in "iu" and kind != np.uint64


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; integers go byte by byte, so that small ones cost little, but for hashes."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if _by_bytes(a.dtype) else a.tobytes()
        out += [struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)), raw]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 1
    for _ in range(data[0]):
        kind, n = struct.unpack_from("<2sQ", data, at)
        kind = np.dtype(kind.decode())
        at += 10
        raw = np.frombuffer(data, np.uint8, n * kind.itemsize, at)
        out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).reshape(-1).view(kind) if _by_bytes(kind) else raw.view(kind))
        at += n * kind.itemsize
    return out


def token_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Tokens, contexts, document of each token, whether documents train, and their rows. Columns: doc_id, text, held_out."""
    for batch in batches:
        data, offsets = tokens.buffers(batch.column(1))
        held = batch.column(2).to_numpy(zero_copy_only=False)
        for i, j in tokens.slices(offsets, BLOCK_BYTES):
            part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, first = tokens.words(part, off, tokens.NONSPACE)
            n = np.diff(first)
            of = np.repeat(np.arange(j - i), n + 1)
            edge = np.concatenate([[0], np.cumsum(n + 1)])
            token = np.full(len(of), END)
            mask = np.ones(len(of), bool)
            mask[edge[1:] - 1] = False
            token[mask] = tokens.hashes(part, starts, ends)
            del starts, ends, mask
            context = np.concatenate([[BEGIN], token[:-1]]) if len(token) else token
            context[edge[:-1]] = BEGIN
            yield token, context, of, ~held[i:j].astype(bool), batch.slice(i, j - i)
            del token, context, of, part
            tokens.trim()
        del batch, data, held  # before the next one is read


def _rows(rows: list[tuple[str, int, int, bytes]]) -> pa.RecordBatch:
    kinds, parts, blocks, payloads = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(parts, pa.int64()), pa.array(blocks, pa.int64()), pa.array(payloads, pa.binary())], names=["kind", "part", "block", "payload"])


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return tokens.mix(w ^ tokens.mix(h))


def _place(names: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each of ``x`` is in the sorted ``names``, or -1."""
    if not len(names):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    return np.where(names[at] == x, at, -1)


def _runs(part: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``n`` numbers that occur in ``part``, where it does."""
    sort = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[sort], np.arange(n + 1).astype(part.dtype))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        yield b, sort[bounds[b] : bounds[b + 1]]


class Frequent:
    """Hot words and hot bigrams with their exact training counts: at most HOT of each."""

    def __init__(self, words: np.ndarray, pairs: list[tuple[int, int]]):
        self.word, self.word_n = np.sort(words), np.zeros(len(words), np.int64)
        h, w = (np.array([p[k] for p in pairs], np.int64).view(np.uint64) for k in range(2))
        key = pair_hash(h, w)
        order = np.argsort(key)
        order = order[_place(self.word, w[order]) >= 0]
        self.pair, self.h, self.w, self.pair_n = key[order], h[order], w[order], np.zeros(len(order), np.int64)

    def context_numbers(self) -> None:
        """The begin mark and the most frequent words are contexts with a number."""
        top = self.word[np.argsort(-self.word_n, kind="stable")[:WIDE]]
        self.wide = np.sort(np.append(top[top != END], BEGIN))


def frequent(docs: DataFrame, share: int = HOT) -> tuple[Frequent, int]:
    """The hot words and bigrams, and the number of all tokens."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What makes 1 in ``share`` of all training tokens does so in some block.
        for token, context, of, train, _ in token_blocks(batches):
            kept = train[of]
            w, h, least, size = token[kept], context[kept], max(1.0, np.count_nonzero(kept) / share), len(token)
            del token, context, of, kept
            u, n = np.unique(w, return_counts=True)
            key, first, m = np.unique(pair_hash(h, w), return_index=True, return_counts=True)
            one, two = n >= least, m >= least
            ws, hs = np.concatenate([u[one], w[first[two]], U([0])]).view(np.int64), np.concatenate([np.zeros(np.count_nonzero(one), np.uint64), h[first[two]], U([0])]).view(np.int64)
            kind = np.repeat([1, 2, 0], [np.count_nonzero(one), np.count_nonzero(two), 1])
            times = np.concatenate([n[one], m[two]])
            n, m = np.append(times, size), np.append(times, len(w))
            del w, h, u, key, first, one, two
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(hs), pa.array(ws), pa.array(n), pa.array(m)], names=["kind", "h", "w", "n", "m"])

    rows = saved(docs.mapInArrow(candidates, "kind long, h long, w long, n long, m long").groupBy("kind", "h", "w").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "katz-frequent")
    total = rows.where("kind = 0").first()
    if not total:
        return Frequent(np.zeros(0, np.uint64), []), 0
    hot = rows.where(f"kind > 0 AND n >= {max(1.0, total.m / share)}").collect()  # at most ``share`` words and ``share`` bigrams
    found = Frequent(np.array([r.w for r in hot if r.kind == 1], np.int64).view(np.uint64), [(r.h, r.w) for r in hot if r.kind == 2])
    shared = docs.sparkSession.sparkContext.broadcast((found.word, found.pair))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        n = [np.zeros(len(x) + 1, np.int64) for x in names]
        for token, context, of, train, _ in token_blocks(batches):
            kept = train[of]
            w = token[kept]
            for k, x in enumerate((w, pair_hash(context[kept], w))):
                n[k] += np.bincount(_place(names[k], x) + 1, minlength=len(n[k]))
            del token, context, of, kept, w, x
        for k in range(2):
            at = np.flatnonzero(n[k][1:])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n[k][1:][at])], names=["kind", "at", "n"])

    for r in docs.mapInArrow(count, "kind long, at long, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect():
        (found.pair_n if r.kind else found.word_n)[r.at] = r.n
    found.context_numbers()
    return found, total.n


def _classes(c: np.ndarray) -> np.ndarray:
    return np.minimum(c, K + 1).astype(np.int64)


def _log_context(n1: np.ndarray, is_word: np.ndarray) -> np.ndarray:
    """What a token takes from the score as the context of the next one."""
    return np.where(is_word, np.log10(np.maximum(n1, 1)), 0.0)


def _numbered(hot: Frequent, x: np.ndarray) -> np.ndarray:
    """0 for a cold word, 1 for the begin mark, else 2 and more for hot words."""
    return np.where(x == BEGIN, 1, _place(hot.word, x) + 2).astype(np.uint16) * ((x == BEGIN) | (_place(hot.word, x) >= 0))


def _named(hot: Frequent, number: np.ndarray, cold: np.ndarray) -> np.ndarray:
    out = np.full(len(number), BEGIN)
    out[number > 1] = hot.word[number[number > 1].astype(np.int64) - 2]
    out[number == 0] = cold
    return out


def _send(docs: DataFrame, buckets: int, hot: Frequent) -> DataFrame:
    """Each block's documents, its sums over hot words and bigrams, and its other bigrams, packed for their partitions."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        block = TaskContext.get().partitionId() << 32
        for token, context, of, train, rows in token_blocks(batches):
            ids, size = rows.column(0), len(train)
            home = block % buckets
            out = [("meta", home, block, pack(np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_valid(), dtype=np.uint8), train.astype(np.uint8), np.bincount(of, minlength=size).astype(np.int64)))]
            at = _place(hot.word, token)
            known = at >= 0
            w, doc = token[known], of[known]
            n1 = hot.word_n[at[known]]
            total = lambda doc, x, size=size: np.bincount(doc, weights=x, minlength=size).astype(float)
            base, logs = total(doc, np.log10(n1 + 0.5)), -total(doc, _log_context(n1, w != END))
            at = _place(hot.pair, pair_hash(context, token))
            own = at >= 0
            n2, n1, doc = hot.pair_n[at[own]], hot.word_n[_place(hot.word, token[own])], of[own]
            seen, large = n2 > 0, n2 > K
            logs += total(doc[large], np.log10(n2[large] - TAIL))
            late = ~seen & (n1 > K)
            logs += total(doc[late], np.log10(n1[late]))
            code = np.where(seen, np.where(large, 0, n2), K + 1 + _classes(n1))  # 0: in logs already
            table = np.bincount(doc * (2 * K + 3) + code, minlength=size * (2 * K + 3)).reshape(size, 2 * K + 3)
            out.append(("local", home, block, pack(base, logs, np.bincount(of[known], weights=hot.word_n[_place(hot.word, w)] > 0, minlength=size).astype(np.int32), table[:, 1:].astype(np.int32).reshape(-1))))
            w, h, of = token[~own], context[~own], of[~own]
            del token, context, rows, ids, at, known, doc, n1, own, n2, seen, large, late, code, table
            if len(w):
                key = pair_hash(h, w)
                order = np.argsort(key, kind="stable")
                order = order[np.argsort(w[order], kind="stable")]
                w, h, of, key = w[order], h[order], of[order], key[order]
                new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])]))
                times = np.diff(np.append(new, len(w)))
                w, h, key = w[new], h[new], key[new]
                del order
                a, b = _numbered(hot, w), _numbered(hot, h)
                part = np.where(a > 0, key, tokens.mix(w)) % U(buckets)
                docs_of = of.astype(np.uint16 if size < 1 << 16 else np.uint32)
                del of, key
                bits = np.packbits(train)
                for k, x in _runs(part, buckets):
                    x = x[np.lexsort((b[x], a[x]))]
                    occurrences, _ = expand(new[x], new[x] + times[x])
                    cold_w = w[x][a[x] == 0]  # in order: a run of one word is sent once
                    runs = np.flatnonzero(np.concatenate([[True], cold_w[1:] != cold_w[:-1]])) if len(cold_w) else np.zeros(0, np.int64)
                    length = np.diff(np.append(runs, len(cold_w)))
                    out.append(("pairs", k, block, pack(a[x], cold_w[runs], length.astype(np.int32), b[x], h[x][b[x] == 0], np.minimum(times[x], 255).astype(np.uint8), times[x][times[x] >= 255].astype(np.int32), docs_of[occurrences], bits)))
                    if len(out) == 64:
                        yield _rows(out)
                        out = []
            del w
            yield _rows(out)
            block += 1

    return docs.mapInArrow(run, ROW)


def _sent(payload: bytes, hot: Frequent) -> tuple[np.ndarray, ...]:
    """Words, contexts, number of occurrences, the occurrences' documents and whether these train."""
    a, cold_w, length, b, cold_h, times, many, of, bits = unpack(payload)
    times = times.astype(np.int32)
    times[times == 255] = many
    return _named(hot, a, np.repeat(cold_w, length)), _named(hot, b, cold_h), times, of, np.unpackbits(bits)[of].astype(bool)


class Part:
    """What a partition by word gives back, gathered part by part."""

    def __init__(self) -> None:
        self.n2, self.n1, self.n = np.zeros(K + 3, np.int64), np.zeros(K + 3, np.int64), 0
        self.tokens: list[tuple[np.ndarray, ...]] = []
        self.seen: list[tuple[np.ndarray, ...]] = []
        self.unseen: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, w: np.ndarray, h: np.ndarray, size: np.ndarray, doc: np.ndarray, train: np.ndarray, hot: Frequent) -> None:
        """Bigrams of some words, as blocks sent them, with the document of each occurrence and whether it trains."""
        in_train = tokens.grouped_sum(train, np.concatenate([[0], np.cumsum(size)]))
        order = np.lexsort((h, w))
        ws, hs = w[order], h[order]
        new = np.concatenate([[True], (ws[1:] != ws[:-1]) | (hs[1:] != hs[:-1])])
        group = (np.cumsum(new) - 1).astype(np.int32)
        c2 = np.bincount(group, weights=in_train[order]).astype(np.int64)
        ws, hs = ws[new], hs[new]
        word = (np.cumsum(np.concatenate([[True], ws[1:] != ws[:-1]])) - 1).astype(np.int32)
        c1 = np.bincount(word, weights=c2).astype(np.int64)
        first = np.searchsorted(word, np.arange(len(c1)))
        at = _place(hot.word, ws[first])
        c1[at >= 0] = hot.word_n[at[at >= 0]]
        cold = c1[at < 0]
        self.n2 += np.bincount(np.minimum(c2, K + 2), minlength=K + 3)
        self.n1 += np.bincount(np.minimum(cold, K + 2), minlength=K + 3)
        self.n += int(cold.sum())
        flag = ((at < 0) + 2 * (ws[first] == END)).astype(np.uint8)[word]  # of each bigram
        of_group = np.empty(len(w), np.int32)
        of_group[order] = group
        of_group = np.repeat(of_group, size)
        self.tokens.append((doc, c2[of_group].astype(np.int32), c1[word[of_group]].astype(np.int32), flag[of_group]))
        x = np.flatnonzero(c2[of_group] == 0)
        self.unseen.append((hs[of_group[x]], doc[x]))
        # Bigrams seen in training, for the statistics of their contexts.
        kept = c2 > 0
        self.seen.append((hs[kept], _classes(c2[kept]).astype(np.uint8), c1[word[kept]]))


def context_stats(h: np.ndarray, c2: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of distinct seen bigrams, and for each: bigrams by class of their count, words by class of theirs, and the larger words' counts."""
    names, back = np.unique(h, return_inverse=True)
    r2, r1, n = _classes(c2), _classes(c1), len(names)
    stats = np.empty((2 * K + 2, n), np.int64)  # row by row: a partition's contexts are many
    for r in range(1, K + 2):
        stats[r - 1] = np.bincount(back[r2 == r], minlength=n)
    for r in range(1, K + 1):
        stats[K + r] = np.bincount(back[r1 == r], minlength=n)
    stats[2 * K + 1] = np.bincount(back[r1 > K], weights=c1[r1 > K], minlength=n)
    return names, stats


def _by_context(names: np.ndarray, buckets: int) -> np.ndarray:
    return tokens.mix(names ^ U(0xC0FFEE)) % U(buckets)


def _by_block(doc: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``n`` blocks with documents among ``doc`` (block << 32 | document), their places, in order."""
    order = np.argsort(doc, kind="stable")
    bounds = np.searchsorted(doc[order] >> 32, np.arange(n + 1))
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        yield k, order[bounds[k] : bounds[k + 1]]


def _joined(rows: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Columns of rows of arrays, each in one array; the rows are used up."""
    columns = [list(x) for x in zip(*rows, strict=True)][::-1]
    rows.clear()
    return [np.concatenate(columns.pop()) for _ in range(len(columns))]


def _count(pairs: list[tuple[int, bytes]], buckets: int, hot: Frequent, part_tokens: int) -> Iterator[tuple[str, int, int, bytes]]:
    """One partition by word: each token's counts, statistics by context, unseen bigrams, counts of counts. Uses ``pairs`` up, and holds no table longer than it needs it."""
    blocks = np.array([b for b, _ in pairs], np.int64)
    held = []
    for k in range(len(pairs)):
        w, h, size, doc, train = _sent(pairs[k][1], hot)
        pairs[k] = None
        held.append((w, h, size, doc.astype(np.int64) | k << 32, train))
    pairs.clear()
    w, h, size, doc, train = _joined(held)
    tokens.trim()
    steps = max(1, math.ceil(len(doc) / part_tokens))
    done = Part()
    if steps == 1:
        done.add(w, h, size, doc, train, hot)
    else:  # a cold word's bigrams stay together
        step = np.where(_place(hot.word, w) >= 0, pair_hash(h, w), tokens.mix(w)) // U(buckets) % U(steps)
        edge = np.concatenate([[0], np.cumsum(size)])
        for _, x in _runs(step, steps):
            at, _ = expand(edge[x], edge[x + 1])
            done.add(w[x], h[x], size[x], doc[at], train[at], hot)
        del step, edge, at, x
    del w, h, size, doc, train
    tokens.trim()
    yield "counts", 0, 0, pack(done.n2, done.n1, np.array([done.n]))
    doc, n2, n1, flag = _joined(done.tokens)
    told = (flag & 1 > 0) | (n2 == 0)  # a seen token of a hot word needs no word count
    for k, x in _by_block(doc, len(blocks)):
        yield "tokens", 0, int(blocks[k]), pack((doc[x] & 0xFFFFFFFF).astype(np.int32), n2[x], flag[x], n1[x][told[x]])
    del doc, n2, n1, flag, told, x
    tokens.trim()
    names, stats = context_stats(*_joined(done.seen))
    number = _place(hot.wide, names)
    if (number >= 0).any():
        yield "wide", 0, 0, pack(number[number >= 0].astype(np.int32), *stats[:, number >= 0])
    cold = np.flatnonzero(number < 0)
    for b, x in _runs(_by_context(names[cold], buckets), buckets):
        yield "contexts", b, 0, pack(names[cold[x]], *stats[:, cold[x]])
    del names, stats, number, cold
    tokens.trim()
    # Unseen bigrams wait for their contexts' weights; those of wide contexts find them with their block.
    context, doc = _joined(done.unseen)
    number = _place(hot.wide, context)
    x = np.flatnonzero(number >= 0)
    for k, y in _by_block(doc[x], len(blocks)):
        yield "late", 0, int(blocks[k]), pack((doc[x[y]] & 0xFFFFFFFF).astype(np.int32), number[x[y]].astype(np.int32))
    x = np.flatnonzero(number < 0)
    for b, y in _runs(_by_context(context[x], buckets), buckets):
        y = x[y]
        y = y[np.argsort(doc[y], kind="stable")]
        yield "unseen", b, 0, pack(context[y], (doc[y] >> 32).astype(np.int32), (doc[y] & 0xFFFFFFFF).astype(np.int32), blocks)


def _katz(n: np.ndarray) -> np.ndarray:
    r = np.arange(1, K + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        common = (K + 1) * n[K + 1] / n[1]
        return ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)


def discounted(n: np.ndarray) -> np.ndarray:
    """Discounted counts for r = 1..K (at index r) from counts of counts n[1..K + 1], by Good-Turing in Katz's form.

    Where the counts of counts are too irregular for that, they are smoothed by a line through
    their logarithms; where that fails too, every count loses 0.5.
    """
    r = np.arange(1, K + 1)
    fits = lambda d: np.isfinite(d).all() and (d > 0).all() and (d <= 1).all() and (d < 1).any()
    d = _katz(n)
    if not fits(d) and (n[1 : K + 2] > 0).all():
        x = np.log(np.arange(1, K + 2))
        slope, start = np.polyfit(x, np.log(n[1 : K + 2]), 1)
        d = _katz(np.concatenate([[0], np.exp(start + slope * x)]))
    if not fits(d):
        d = (r - 0.5) / r
    return np.concatenate([[0], d * r])


class Constants:
    """All that needs the whole corpus: n_tokens, vocabulary, discounts, and the unigram model."""

    def __init__(self, n2: np.ndarray, n1: np.ndarray, n: int, vocabulary: int, train_docs: int):
        self.n, self.vocabulary, self.train_docs = n, vocabulary, train_docs
        self.two = discounted(n2.astype(float))
        one = discounted(n1.astype(float))
        #: p(w) for counts 1..K, the factor of larger counts, and p of the one unknown word.
        free = sum(n1[r] * (r - one[r]) for r in range(1, K + 1))
        if n and free > 0:
            self.one, self.large, self.unknown = one / n, 1 / n, free / n
        else:
            self.one, self.large, self.unknown = np.arange(K + 1) / (n + 1), 1 / (n + 1), 1 / (n + 1)

    def leftover(self, stats: np.ndarray) -> np.ndarray:
        """log10 of alpha(h) c(h) for contexts' statistics (rows as in ``_count``)."""
        mass = sum(stats[r - 1] * (r - self.two[r]) for r in range(1, K + 1)) + TAIL * stats[K]
        lower = sum(stats[K + r] * self.one[r] for r in range(1, K + 1)) + self.large * stats[2 * K + 1]
        return np.log10(mass) - np.log10(1 - lower)


def _grouped(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of sorted batches, group by group; only the group's own are copied. What others left free before goes back to the system."""
    at, held = None, []
    tokens.trim()
    for batch in batches:
        of = batch.column(column).to_pylist()
        for i in range(len(of)):
            if at is not None and of[i] != at:
                yield at, held
                held = []
                tokens.trim()
            at = of[i]
            held.append(tuple(c[i].as_py() for c in batch.columns))
        del batch
    if held:
        yield at, held
    held = None
    tokens.trim()


def _wide_stats(table: DataFrame, hot: Frequent) -> np.ndarray:
    """Statistics of the wide contexts (rows as in ``context_stats``), hot bigrams left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * K + 2, WIDE + 1), np.int64)
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                at, *stats = unpack(payload)
                for row, x in zip(total, stats, strict=True):
                    row[at] += x  # a context is in a payload once
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(2 * K + 2), WIDE + 1)), pa.array(np.tile(np.arange(WIDE + 1), 2 * K + 2)), pa.array(total.ravel())], names=["k", "at", "n"])

    out = np.zeros((2 * K + 2, len(hot.wide)), np.int64)
    for r in table.where("kind = 'wide'").select("payload").mapInArrow(run, "k long, at long, n long").where("n > 0").groupBy("k", "at").agg(F.sum("n").alias("n")).collect():
        out[r.k, r.at] = r.n
    return out


def score(docs: DataFrame, share: int = HOT, bucket_tokens: int = BUCKET_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row (doc_id, text, held_out)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    hot, all_tokens = frequent(docs, share)
    if not all_tokens:
        hot.context_numbers()
    buckets = max(1, math.ceil(all_tokens / bucket_tokens))
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 1):
            ready = [r for r in rows if r[0] != "pairs"]
            pairs = [(r[2], r[3]) for r in rows if r[0] == "pairs"]
            rows.clear()
            if ready:
                yield _rows(ready)
            out = []
            for row in _count(pairs, buckets, shared.value, part_tokens) if pairs else ():
                out.append(row)
                if len(out) == 64:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    sent = _send(docs, buckets, hot)  # a task for each part below: dealt by hash, several would meet in one
    table = saved(sent.repartitionById(buckets, F.col("part").cast("int")).sortWithinPartitions("part", "block").mapInArrow(count, ROW), "katz")
    n2, n1, n, train_docs = np.zeros(K + 3, np.int64), np.zeros(K + 3, np.int64), 0, 0

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, c, d = np.zeros(K + 3, np.int64), np.zeros(K + 3, np.int64), 0, 0
        for batch in batches:
            for kind, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = unpack(payload)
                if kind == "counts":
                    a, b, c = a + x[0], b + x[1], c + int(x[2][0])
                else:
                    d += int(x[2].sum())
        both = np.concatenate([a, b, [c, d]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both)], names=["at", "n"])

    for r in table.where("kind IN ('counts', 'meta')").select("kind", "payload").mapInArrow(summed, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        if r.at < K + 3:
            n2[r.at] = r.n
        elif r.at < 2 * K + 6:
            n1[r.at - K - 3] = r.n
        elif r.at == 2 * K + 6:
            n = r.n
        else:
            train_docs = r.n
    n += int(hot.word_n.sum())
    n1 = n1 + np.bincount(np.minimum(hot.word_n, K + 2), minlength=K + 3)
    n2 = n2 + np.bincount(np.minimum(hot.pair_n, K + 2), minlength=K + 3)
    constants = Constants(n2, n1, n, int(n1[1:].sum()), train_docs)
    # Hot bigrams' share of their contexts' statistics.
    extra, extra_stats = context_stats(hot.h, hot.pair_n, hot.word_n[_place(hot.word, hot.w)])
    wide = _wide_stats(table, hot)
    number = _place(hot.wide, extra)
    wide[:, number[number >= 0]] += extra_stats[:, number >= 0]
    extra, extra_stats = extra[number < 0], extra_stats[:, number < 0]
    seen = wide[: K + 1].sum(axis=0) > 0
    wide_left = np.where(seen, constants.leftover(np.where(seen, wide, 1)), 0.0) if constants.n else np.zeros(len(hot.wide))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches, 1):
            tables = [unpack(r[3]) for r in rows if r[0] == "contexts"]
            own = _by_context(extra, buckets) == U(part)
            tables.append([extra[own], *extra_stats[:, own]])
            names, back = np.unique(np.concatenate([t[0] for t in tables]), return_inverse=True)
            stats = np.empty((2 * K + 2, len(names)))
            for k in range(1, 2 * K + 3):
                stats[k - 1] = np.bincount(back, weights=np.concatenate([t[k] for t in tables]), minlength=len(names))
            left = constants.leftover(stats) if len(names) else np.zeros(0)
            del tables, back, stats
            found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for r in rows:
                if r[0] != "unseen" or not len(names):
                    continue
                h, own, doc, blocks = unpack(r[3])
                at = _place(names, h)
                value = np.where(at >= 0, left[at], 0.0)
                bounds = np.searchsorted(own, np.arange(len(blocks) + 1))
                for k in np.flatnonzero(np.diff(bounds)).tolist():
                    a, b = bounds[k], bounds[k + 1]
                    found.setdefault(int(blocks[k]), []).append((doc[a:b], value[a:b]))
            out = []
            for block, pieces in found.items():
                doc, back = np.unique(np.concatenate([p[0] for p in pieces]), return_inverse=True)
                total = np.bincount(back, weights=np.concatenate([p[1] for p in pieces]))
                out.append(("backed", 0, block, pack(doc.astype(np.int32), total)))
                if len(out) == 64:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    backed = table.where("kind IN ('contexts', 'unseen')").repartitionById(buckets, F.col("part").cast("int")).sortWithinPartitions("part").mapInArrow(weigh, ROW)
    two, one = np.log10(np.maximum(constants.two, 1e-300)), np.log10(np.maximum(constants.one, 1e-300))
    base_log = math.log10(constants.n + 0.5 * (constants.vocabulary + 1)) if constants.n or constants.vocabulary else 0.0
    begin = math.log10(train_docs) if train_docs else 0.0
    unseen = np.concatenate([[math.log10(constants.unknown)], one[1:], [math.log10(constants.large)]])  # by class of the word's count
    weight = np.concatenate([two[1:], unseen])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 2):
            ids, valid, train, n_tokens = next(unpack(r[3]) for r in rows if r[0] == "meta")
            size = len(ids)
            base, total, known, classes = next(unpack(r[3]) for r in rows if r[0] == "local")
            base, total, known = base.copy(), total + classes.reshape(size, len(weight)) @ weight, known.astype(np.int64)
            for r in rows:
                if r[0] == "tokens":
                    at, n2, flag, told = unpack(r[3])
                    cold, n1 = flag & 1 > 0, np.ones(len(at), np.int64)
                    n1[cold | (n2 == 0)] = told
                    # A token's logarithm: of its discounted bigram count, or else of its word's probability.
                    value = np.where(n2 > K, np.log10(np.maximum(n2 - TAIL, 1)), two[np.minimum(n2, K)])
                    lower = unseen[_classes(n1)] + np.where(n1 > K, np.log10(n1), 0)
                    value = np.where(n2 > 0, value, lower) - np.where(cold, _log_context(n1, flag & 2 == 0), 0)
                    total += np.bincount(at, weights=value, minlength=size)
                    base += np.bincount(at, weights=np.where(cold, np.log10(n1 + 0.5), 0), minlength=size)
                    known += np.bincount(at[cold & (n1 > 0)], minlength=size)
                elif r[0] == "backed":
                    at, value = unpack(r[3])  # a document is in a payload once
                    total[at] += value
                elif r[0] == "late":
                    at, number = unpack(r[3])
                    total += np.bincount(at, weights=wide_left[number], minlength=size)
            score_ = total - begin if constants.n else np.zeros(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=valid == 0), pa.array(train == 0), pa.array(n_tokens), pa.array(known), pa.array(np.full(size, constants.n)), pa.array(base - n_tokens * base_log), pa.array(score_)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    final = table.where("kind IN ('meta', 'local', 'tokens', 'late')").union(backed).repartition("block").sortWithinPartitions("block")
    return final.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
