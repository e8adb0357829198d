"""Quality classifier by co-training of two views of a document.

The text view is a logistic regression over hashed words (each counted once) and sees nothing
else; the metadata view, one over source, language and the page's layout (lengths, lines, links,
addresses, shares of digits, capitals, marks, repeated words), sees no word. Over ROUNDS, each
view labels the pool's documents that it is surest of, as many of each class as that class's
share allows, and hands them to the other view's training set, on which that view's training
goes on. A view hands over only what lies beyond a cut (``Model.cuts``) at which it has proved
better than chance on labelled documents kept for calibration: a view that can't tell the
classes apart teaches the other nothing. Each view is then calibrated (Platt scaling) on these
documents, and a logistic regression over the two calibrated views gives the score of every
document.

Models are fitted on the driver to at most about LABELLED labelled and POOL unlabelled
documents, chosen by a hash of their ids; weights (2 MB) are broadcast and all documents
are scored in one pass with no shuffle.

Defined results: null text is empty; null source and language are values of their own; with
one class or no labels every score is the share of the positive class (0.5 without labels);
of several labels of one id the largest counts; equal rows score equally; a null id is
scored but never trained on; input columns named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens

LABELLED, POOL, ROUNDS = 6000, 6000, 5
#: Steps of training on the labelled documents, and on the larger set of each later round.
FIRST_STEPS, STEPS = 100, 40
WORDS, SOURCES = 1 << 18, 256
#: What a view hands over has at most this share of the errors that chance would make.
LESS = 0.6
#: Weight decay of the text view (many words, few of them telling) and of the metadata view.
KEEP = (1e-4, 1e-5)
#: Words in fewer documents of the sample than this have no weight: they are too rare to tell anything.
RAREST = 5
MEASURES = 14
META = MEASURES + 2 * SOURCES


def _starts(data: np.ndarray, word: bytes) -> np.ndarray:
    """Where ``word`` stands."""
    found = np.zeros(len(data), bool)
    n = len(data) - len(word) + 1
    if n > 0:
        found[:n] = np.logical_and.reduce([data[k : k + n] == c for k, c in enumerate(word)])
    return found


def views(text: pa.Array, source: pa.Array, lang: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row: hashed distinct words, and metadata as (position, value) pairs in one dense vector."""
    data, offsets = tokens.buffers(text)
    named = []
    for column, base in ((source, 0), (lang, SOURCES)):
        values, off = tokens.buffers(column.fill_null("\x00"))
        whole = [tokens.hashes(values[a:b], np.zeros(1, np.int64), np.array([b - a])) if b > a else np.zeros(1, np.uint64) for a, b in zip(off[:-1], off[1:], strict=True)]
        named.append(MEASURES + base + (np.concatenate(whole) % tokens.U(SOURCES)).astype(np.int64) if whole else np.zeros(0, np.int64))
    for i, j in tokens.slices(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = tokens.words(part, off, tokens.ALNUM)
        ids = (tokens.hashes(part, starts, ends) % tokens.U(WORDS)).astype(np.int64)
        total = lambda mask, off=off: tokens.grouped_sum(mask, off)
        size = np.maximum(1, np.diff(off))
        digit, upper, line = total((part >= 48) & (part < 58)), total((part >= 65) & (part < 91)), total(part == 10)
        mark = total(((part > 32) & (part < 48)) | ((part > 57) & (part < 65)) | ((part > 90) & (part < 97)) | ((part > 122) & (part < 127)))
        link, address = total(_starts(part, b"http")), total(part == 64)
        wide, odd, bar = total(part > 127), total((part == 35) | (part == 36) | (part == 37) | (part == 38) | (part == 42)), total(part == 124)
        n = np.diff(first)
        for k in range(j - i):
            own = np.unique(ids[first[k] : first[k + 1]])
            meta = np.zeros(META, np.float32)
            meta[:MEASURES] = 1, np.log1p(size[k]) / 5, np.log1p(n[k]) / 5, np.log1p(line[k]) / 3, 10 * digit[k] / size[k], 5 * upper[k] / size[k], 5 * mark[k] / size[k], wide[k] / size[k], 10 * odd[k] / size[k], 10 * bar[k] / size[k], len(own) / max(1, n[k]), min(4.0, size[k] / max(1, n[k]) / 6), np.log1p(link[k]), np.log1p(address[k])
            meta[named[0][i + k]] = meta[named[1][i + k]] = 1
            yield own, meta


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Sparse:
    """Rows of distinct positions, each of the same weight, with length 1."""

    def __init__(self, rows: list[np.ndarray], size: int):
        self.n, self.size = len(rows), size
        self.at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.edge = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), np.diff(self.edge))
        self.value = 1 / np.sqrt(np.maximum(1, np.diff(self.edge)))

    def times(self, w: np.ndarray) -> np.ndarray:
        return tokens.grouped_sum(w[self.at].astype(float), self.edge) * self.value

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=(g * self.value)[self.row], minlength=self.size)

    def part(self, chosen: np.ndarray) -> tuple[Sparse, np.ndarray]:
        """The chosen rows over the positions that they have, and those positions."""
        own = np.flatnonzero(chosen)
        used, at = np.unique(self.at[np.repeat(chosen, np.diff(self.edge))], return_inverse=True)
        edge = np.concatenate([[0], np.cumsum(np.diff(self.edge)[own])])
        return Sparse([at[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)], len(used)), used


class Dense:
    def __init__(self, x: np.ndarray):
        self.n, self.x, self.size = len(x), x, x.shape[1]

    def times(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def back(self, g: np.ndarray) -> np.ndarray:
        return g @ self.x

    def part(self, chosen: np.ndarray) -> tuple[Dense, np.ndarray]:
        return Dense(self.x[chosen]), np.arange(self.size)


def logistic(x: Sparse | Dense, y: np.ndarray, weight: np.ndarray, steps: int = 100, rate: float = 0.5, keep: float = 1e-5, start: np.ndarray | None = None) -> np.ndarray:
    """Weights and, last, the intercept; full gradients with Adagrad, from ``start`` on."""
    w, bias = (np.zeros(x.size), 0.0) if start is None else (start[:-1].copy(), float(start[-1]))
    sum_w, sum_b = np.full(x.size, 1e-8), 1e-8
    weight = weight / weight.sum()
    for _ in range(steps):
        g = weight * (_sigmoid(x.times(w) + bias) - y)
        slope = x.back(g) + keep * w
        sum_w += slope * slope
        sum_b += g.sum() ** 2
        w -= rate * slope / np.sqrt(sum_w)
        bias -= rate * g.sum() / np.sqrt(sum_b)
    return np.append(w, bias)


class Model:
    """Weights of both views, their calibrations, and the combination."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, fold: np.ndarray, rounds: int = ROUNDS):
        """label: 1, 0, or -1 in the pool; fold: those with 2 are kept for calibration."""
        known = label >= 0
        self.share = float(label[known].mean()) if known.any() else 0.5
        self.fitted = 0 < self.share < 1 and len(np.unique(label[known & (fold != 2)])) == 2 and len(np.unique(label[known & (fold == 2)])) == 2
        if not self.fitted:
            return
        times = np.bincount(np.concatenate([a for a, _ in rows]), minlength=WORDS)
        x = [Sparse([a[times[a] >= RAREST] for a, _ in rows], WORDS), Dense(np.stack([b for _, b in rows]).astype(float))]
        own = [np.where(known & (fold != 2), label, -1) for _ in x]
        pool = ~known
        self.w = [np.zeros(x[0].size + 1), np.zeros(x[1].size + 1)]
        for turn in range(rounds + 1):
            for v in range(2):
                part, used = x[v].part(own[v] >= 0)
                used = np.append(used, x[v].size)
                self.w[v][used] = logistic(part, own[v][own[v] >= 0], np.ones(part.n), steps=STEPS if turn else FIRST_STEPS, keep=KEEP[v], start=self.w[v][used])
            if turn == rounds or not pool.any():
                break
            new = [o.copy() for o in own]
            for v in range(2):
                p = self.view(v, x[v])
                low, high = self.cuts(p[known & (fold == 2)], label[known & (fold == 2)])
                open_ = np.flatnonzero(pool & (own[1 - v] < 0))
                most = max(1, int(0.1 * pool.sum()))
                order = open_[np.argsort(-p[open_], kind="stable")]
                yes, no = order[: int(round(most * self.share))], order[::-1][: int(round(most * (1 - self.share)))]
                new[1 - v][yes[p[yes] > max(1.0, high)]] = 1  # odds of e to 1, at least
                new[1 - v][no[p[no] < min(-1.0, low)]] = 0
            own = new
        held = np.flatnonzero(known & (fold == 2))
        self.scale, calibrated = [], []
        for v in range(2):
            p = self.view(v, x[v])[held]
            a = logistic(Dense(p[:, None] / 4), label[held], np.ones(len(held)), steps=300)
            self.scale.append((a[0] / 4, a[1]))
            calibrated.append(p * a[0] / 4 + a[1])
        self.combined = logistic(Dense(np.stack(calibrated, axis=1)), label[held], np.ones(len(held)), steps=300)

    def cuts(self, p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Where a view's word can be relied on: the highest score under which, and the lowest over which, its errors on labelled
        documents that it wasn't trained on are at most LESS of what they would be by chance; infinite where there is none."""
        order = np.argsort(p, kind="stable")
        n = np.arange(1, len(p) + 1)
        wrong_low, wrong_high = np.cumsum(y[order] == 1), np.cumsum(y[order[::-1]] == 0)
        low = np.flatnonzero((n >= 20) & ((wrong_low + 1) / (n + 2) <= LESS * self.share))
        high = np.flatnonzero((n >= 20) & ((wrong_high + 1) / (n + 2) <= LESS * (1 - self.share)))
        return (float(p[order[low[-1]]]) if len(low) else -np.inf), (float(p[order[::-1][high[-1]]]) if len(high) else np.inf)

    def view(self, v: int, x: Sparse | Dense) -> np.ndarray:
        return x.times(self.w[v][:-1]) + self.w[v][-1]

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """text_score, meta_score and score of each row."""
        if not self.fitted or not rows:
            return np.full((3, len(rows)), self.share)
        x = [Sparse([a for a, _ in rows], WORDS), Dense(np.stack([b for _, b in rows]).astype(float))]
        logits = np.stack([self.view(v, x[v]) * self.scale[v][0] + self.scale[v][1] for v in range(2)])
        return _sigmoid(np.vstack([logits, self.combined[:-1] @ logits + self.combined[-1]]))


def fit(docs: DataFrame, labels: DataFrame, targets: list[str], labelled: int = LABELLED, pool: int = POOL) -> list[Model]:
    """A model for each of the columns ``targets`` of ``labels``, all from one sample. A null label is none."""
    rows = docs.select("doc_id", F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string")).where("doc_id IS NOT NULL")
    marks = labels.where(F.col("doc_id").isNotNull() & F.coalesce(*targets).isNotNull()).groupBy("doc_id").agg(*(F.max(t).cast("int").alias(f"label_{k}") for k, t in enumerate(targets)))
    few = max(1, marks.count() // labelled)
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(few)) == 0)
    every = max(1, rows.count() // pool)
    marked = rows.join(marks, "doc_id")
    unmarked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(every)) == 0).join(labels.select("doc_id"), "doc_id", "left_anti")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(3)).cast("int")
    given = [f"label_{k}" for k in range(len(targets))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(views(*batch.columns[1:4]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[4:], pa.array([a.astype(np.int32).tobytes() for a, _ in made], pa.binary()), pa.array([b.tobytes() for _, b in made], pa.binary())], names=["doc_id", *given, "fold", "words", "meta"])

    drawn = marked.unionByName(unmarked, allowMissingColumns=True).fillna(-1, given).withColumn("fold", fold)
    schema = f"doc_id long, {', '.join(f'{g} int' for g in given)}, fold int, words binary, meta binary"
    got = drawn.mapInArrow(run, schema).toArrow().to_pandas().sort_values(["doc_id", "words", "meta"])
    pairs = [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(b, np.float32)) for a, b in zip(got["words"], got["meta"], strict=True)]
    return [Model(pairs, got[g].to_numpy(), got["fold"].to_numpy()) for g in given]


def predict(docs: DataFrame, models: dict[str, Model]) -> DataFrame:
    """``docs`` with text_score, meta_score and score by each model, each name after the model's key."""
    names = [f"{prefix}{n}" for prefix in models for n in ("text_score", "meta_score", "score")]
    kept = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(list(models.values()))
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = lambda rows: np.concatenate([m.scores(rows) for m in shared.value])
        for batch in batches:
            column = lambda n, b=batch: b.column(b.schema.get_field_index(n))
            out, held = [], []
            for row in views(column("text"), column("source"), column("lang")):
                held.append(row)
                if len(held) == 2000:
                    out.append(scores(held))
                    held = []
            out.append(scores(held))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in np.concatenate(out, axis=1))], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)
