"""Language identification: multinomial naive Bayes over hashed character n-grams.

Every letter yields three features, hashed into one table: itself, itself with the
character before it, and itself between its two neighbours. Characters that are no
letters, and the edges of a text, count as one blank; letters are lower-cased. Training
counts all letters of all training documents; the log-probability matrix
(languages x FEATURES, float32, at most MAX_LANGUAGES rows) is broadcast and texts are
scored in numpy, batch by batch, with no shuffle.

Defined results: null text or a text without letters is ``und`` with score 0.0; ties go
to the smallest language name; rows repeat as they are; with no training row every text
is ``und``; input columns named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens

FEATURES = 1 << 15
#: The broadcast matrix has 128 KB a language; more languages than this are an error.
MAX_LANGUAGES = 512
#: For the score, a text counts as at most so many features; the choice uses all of them.
EVIDENCE = 64
_FOLDED: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """For each code point its lower-case letter, or 32."""
    if not _FOLDED:
        out = np.full(0x110000, 32, np.uint32)
        for i in (*range(0xD800), *range(0xE000, 0x110000)):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _FOLDED.append(out)
    return _FOLDED[0]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (3 x letters) and the index of each document's first letter."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = tokens.codepoint_index(data, offsets)
    c = _folded()[points]
    left = np.empty_like(c)
    right = np.empty_like(c)
    left[:1], right[-1:] = 32, 32
    left[1:], right[:-1] = c[:-1], c[1:]
    left[edges[:-1][edges[:-1] < len(c)]] = 32
    ends = edges[1:] - 1
    right[ends[ends >= 0]] = 32
    at = np.flatnonzero(c != 32)
    left, mid, right = left[at], c[at], right[at]
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    one = mid * np.uint32(0x9E3779B1)
    two = (one ^ (left * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = ((two ^ (right * np.uint32(0x27D4EB2F))) + np.uint32(0x165667B1)) * np.uint32(0x9E3779B1)
    return np.stack([(one * np.uint32(0x85EBCA6B)) >> shift, two >> shift, three >> shift]), np.searchsorted(at, edges)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, log priors, and log probabilities (languages x FEATURES), from all given rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).dictionary_encode()
            code, known = names.indices.to_numpy(zero_copy_only=False), names.dictionary.to_pylist()
            data, offsets = tokens.buffers(batch.column(0))
            for i, j in tokens.slices(offsets):
                found, first = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = np.repeat(code[i:j], np.diff(first)).astype(np.int64) * FEATURES
                sums = sum(np.bincount(own + f, minlength=len(known) * FEATURES) for f in found)
                for k in np.unique(code[i:j]):
                    have = total.setdefault(known[k], np.zeros(FEATURES + 1, np.int64))
                    have[:-1] += sums[k * FEATURES : (k + 1) * FEATURES]
                    have[-1] += np.count_nonzero(code[i:j] == k)
        for name, have in total.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(have[at])], names=["lang", "feature", "n"])

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).cast("string").alias(text), F.col(lang).cast("string").alias(lang))
    names = sorted(r.lang for r in rows.select(F.col(lang).alias("lang")).distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages, the model's bound")
    counts = rows.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    matrix = np.zeros((len(names), FEATURES + 1))
    if names:
        matrix[np.searchsorted(names, found["lang"].to_numpy(str)), found["feature"].to_numpy()] = found["n"].to_numpy()
    prior = np.log(np.maximum(matrix[:, -1], 1) / max(matrix[:, -1].sum(), 1))
    smooth = matrix[:, :-1] + 0.5
    return names, prior, np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score; rows and other columns as they are."""
    kept = docs.drop(pred, score)
    names, prior, _ = model
    shared = docs.sparkSession.sparkContext.broadcast(model[2])
    schema = T.StructType([*kept.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = shared.value
        for batch in batches:
            data, offsets = tokens.buffers(batch.column(batch.schema.get_field_index(text)))
            best, sure = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for i, j in tokens.slices(offsets) if names else ():
                found, first = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.diff(first)
                sums = np.stack([tokens.grouped_sum(row[found[0]] + row[found[1]] + row[found[2]], first) for row in logp])
                top = np.argmax(sums + prior[:, None], axis=0)
                logits = sums * np.minimum(1, EVIDENCE / np.maximum(1, 3 * n)) + prior[:, None]
                logits -= logits.max(axis=0)
                p = np.exp(logits)
                best[i:j] = np.where(n > 0, top, -1)
                sure[i:j] = np.where(n > 0, (p / p.sum(axis=0))[top, np.arange(j - i)], 0)
            out = pa.array(np.array([*names, "und"], object)[best].tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out, pa.array(sure)], names=[*batch.schema.names, pred, score])

    return kept.mapInArrow(run, schema)
