"""Secret scan: fixed patterns, and a linear-chain CRF that adds spans.

Tokens (runs of letters, digits, ``+/_.=-`` and non-ASCII) are tagged secret begin, inside
or outside. Features, hashed into one weight table: the token's shape, how often its
characters change class, its longest runs and its signs, its neighbours and their shapes,
the characters around it, and file features (key words in the text, share of digits) with
the shape. Training windows come from about SAMPLE documents chosen by a hash of their ids
and texts, at most WINDOWS windows of each: the patterns' own secrets give the labels. As
the patterns find those anyway, each is there again with the key word before it hidden and
another made-up key in its place; windows with made-up keys and harmless look-alikes in many
layouts are added, so that the model learns keys that the patterns don't list. Weights are
trained on the driver by exact forward-backward gradients and broadcast (768 KB).

Decoding is exact Viterbi over whole texts. A token whose score for outside is ahead by
more than transitions could ever repay is outside in every best path; such tokens cut the
text into the short runs that are decoded. Only the training sample shuffles.

A span of the model that the patterns' matches cover is left out; one that reaches beyond them
is a span of its own, and the matches stay beside it.

Defined results: null text is empty; a text without tokens has no spans; ties go to
outside, then begin; equal rows give equal results, and rows that repeat are one in training;
a table without training windows adds no spans; input columns named like the outputs are
replaced.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
WORDS = (b"passw", b"secret", b"token", b"api")
SAMPLE, WINDOWS, WINDOW, TABLE = 5000, 8, 17, 1 << 16
O, B, I = 0, 1, 2
HEX = tokens._class([(0, 255)])
HEX[48:58] = HEX[97:103] = True
TOKEN = tokens._class([(0, 127)])
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    TOKEN[_a:_b] = True
for _c in b"+/_.=-":
    TOKEN[_c] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def base_spans(text: str, lower: bytes, hexes: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the patterns' matches, and the secrets inside them. ``hexes``: runs of hex digits, in code points."""
    found, inner = [], []
    if any(w in lower for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                found.append((m.start(), 0, m.end()))
                inner.append(m.span(2))
    if b"akia" in lower:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 18:
                found.append((m.start(), 1, m.end()))
                inner.append(m.span())
    for a, b in hexes:
        if b - a >= 16:
            found.append((a, 2, b))
            inner.append((a, b))
    return sorted(found), inner


def merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of sorted spans."""
    starts, ends = [], []
    for p, _, q in spans:
        if starts and p <= ends[-1]:
            ends[-1] = max(ends[-1], q)
        else:
            starts.append(p)
            ends.append(q)
    return starts, ends


def covered(start: int, end: int, union: tuple[list[int], list[int]]) -> bool:
    """Whether a union of spans leaves nothing of a span."""
    k = bisect_right(union[0], start) - 1
    return k >= 0 and end <= union[1][k]


def _classes() -> np.ndarray:
    """Counted properties of bytes: lower, upper, digit, sign, non-ASCII, hex letter, vowel."""
    c = np.zeros((7, 256), np.int32)
    c[0, 97:123] = c[1, 65:91] = c[2, 48:58] = c[4, 128:] = c[5, 97:103] = 1
    c[3, list(b"+/_.=-")] = 1
    c[6, list(b"aeiouyAEIOUY")] = 1
    return c


_COUNTED = _classes()
_SIGNS = b"_-./=+"
FEATURES = 13


def _kinds() -> np.ndarray:
    """Of each byte: 0 lower, 1 upper, 2 digit, 3 sign, 4 non-ASCII, 5 outside of tokens."""
    c = np.full(256, 5, np.uint8)
    c[97:123], c[65:91], c[48:58], c[128:] = 0, 1, 2, 4
    c[list(_SIGNS)] = 3
    return c


_KIND = _kinds()


def _runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each token: changes of class, and the longest runs of lower-case letters, of digits, and of any class."""
    kind = _KIND[data]
    new = np.empty(len(kind), bool)
    new[0] = True
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True  # a token ends at a byte of another class, or where the next one starts
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(kind)))
    own = kind[begin]
    first = np.searchsorted(begin, starts)
    changes = np.searchsorted(begin, ends) - first - 1
    longest = lambda mask: np.maximum.reduceat(np.where(mask, length, 0), first)
    return changes, longest(own == 0), longest(own == 2), longest(own < 5)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, each document's first token, and hashed features (count x tokens)."""
    starts, ends, first = tokens.words(data, offsets, TOKEN)
    n = len(starts)
    if not n:
        return starts, ends, first, np.zeros((FEATURES, 0), np.int64)
    counts = []
    for row in _COUNTED:
        run = np.zeros(len(data) + 1, np.int32)
        np.cumsum(row[data], out=run[1:])
        counts.append((run[ends] - run[starts]).astype(np.int64))
    size = ends - starts
    low, up, digit, sign, wide, hexa, vowel = counts
    band = np.searchsorted([1, 2, 4, 8, 12, 16, 20, 24, 32, 40, 64], size, "right")
    part = lambda x: np.where(x == 0, 0, np.where(x == size, 3, np.where(4 * x < size, 1, 2)))
    shape = band
    for x in (part(low), part(up), part(digit), np.minimum(sign, 2), np.minimum(wide, 1), ((low == hexa) & (up == 0)).astype(np.int64), (5 * vowel < size).astype(np.int64)):
        shape = shape * 4 + x
    own = tokens.hashes(data, starts, ends)
    edge_low, edge_high = np.zeros(n, bool), np.zeros(n, bool)
    edge_low[first[:-1][first[:-1] < n]] = True
    last = first[1:] - 1
    edge_high[last[last >= 0]] = True
    before = np.concatenate([[0], np.arange(n - 1)])
    after = np.minimum(np.arange(n) + 1, n - 1)
    prev = np.where(edge_low, tokens.U(1), own[before])
    nxt = np.where(edge_high, tokens.U(2), own[after])
    prev2 = np.where(edge_low | edge_low[before], tokens.U(3), own[before[before]])
    shape = shape.astype(np.uint64)
    shape_prev = np.where(edge_low, tokens.U(1 << 40), shape[before])
    shape_next = np.where(edge_high, tokens.U(1 << 40), shape[after])
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    char_low = np.where(starts > offsets[of], data[np.maximum(starts - 1, 0)], 0).astype(np.uint64)
    char_high = np.where(ends < offsets[of + 1], data[np.minimum(ends, len(data) - 1)], 0).astype(np.uint64)
    named = np.zeros(len(first) - 1, np.uint64)
    for k in range(len(first) - 1):
        text = data[offsets[k] : offsets[k + 1]].tobytes().translate(_LOWER)
        named[k] = any(w in text for w in WORDS)
    digits = tokens.grouped_sum(digit, first)
    share = np.searchsorted([0.002, 0.01, 0.05], digits / np.maximum(1, offsets[1:] - offsets[:-1])).astype(np.uint64)
    file = (named * tokens.U(4) + share)[of]
    changes, low_run, digit_run, run = _runs(data, starts, ends)
    level = lambda x: np.searchsorted([1, 2, 3, 4, 6, 8, 12, 16, 24], x, "right").astype(np.uint64)
    signs = np.zeros(n, np.uint64)
    for c in _SIGNS:
        held = np.zeros(len(data) + 1, np.int32)
        np.cumsum(data == c, out=held[1:])
        signs = signs * tokens.U(4) + np.minimum(held[ends] - held[starts], 3).astype(np.uint64)
    mixed = (10 * changes // np.maximum(1, size)).astype(np.uint64) * tokens.U(16) + band.astype(np.uint64)
    runs = level(low_run) * tokens.U(256) + level(digit_run) * tokens.U(16) + level(run)
    parts = (part(up) * 4 + part(digit)).astype(np.uint64)
    made = [shape, prev, nxt, prev2, char_low * tokens.U(256) + char_high, shape_prev * tokens.U(1 << 20) + shape, shape_next * tokens.U(1 << 20) + shape, file * tokens.U(1 << 32) + shape, np.where(size < 12, own, shape)]
    made += [mixed, runs * tokens.U(16) + parts, signs * tokens.U(16) + parts, (mixed * tokens.U(4096) + runs) * tokens.U(16) + parts]
    shift = tokens.U(64 - TABLE.bit_length() + 1)
    return starts, ends, first, np.stack([(tokens.mix(x + tokens.U(0x1234567 * (k + 1))) >> shift).astype(np.int32) for k, x in enumerate(made)])


def _hexes(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int]]]:
    """Runs of 16 or more hex digits of each document, in its code points."""
    a, b, _ = tokens.words(data, offsets, HEX)
    keep = b - a >= 16
    a, b = a[keep], b[keep]
    heads = np.flatnonzero((data & 0xC0) != 0x80) if len(a) else np.zeros(0, np.int64)
    of = np.searchsorted(offsets, a, "right") - 1
    zero = np.searchsorted(heads, offsets)
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(offsets) - 1)]
    for d, x, y in zip(of.tolist(), (np.searchsorted(heads, a) - zero[of]).tolist(), (np.searchsorted(heads, b) - zero[of]).tolist(), strict=True):
        out[d].append((x, y))
    return out


def _labelled(texts: list[str], own: list[list[tuple[int, int]]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features x WINDOW, labels) around secrets, WINDOWS of them spread over a text, and one window anywhere. A label of -1 is padding."""
    data, offsets = tokens.buffers(pa.array(texts, pa.large_string()))
    starts, ends, first, f = features(data, offsets)
    hexes = _hexes(data, offsets)
    for k, text in enumerate(texts):
        a, b = int(first[k]), int(first[k + 1])
        if a == b:
            continue
        raw = data[offsets[k] : offsets[k + 1]]
        secrets = own[k] if own else base_spans(text, raw.tobytes().translate(_LOWER), hexes[k])[1]
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        label = np.zeros(b - a, np.int64)
        s, e = np.searchsorted(heads, starts[a:b] - offsets[k]), np.searchsorted(heads, ends[a:b] - offsets[k])
        for x, y in secrets:
            inside = np.flatnonzero((s < y) & (e > x))
            label[inside] = I
            label[inside[:1]] = B
        marked = np.flatnonzero(label == B)
        marked = marked[:: -(-len(marked) // WINDOWS) or 1].tolist()
        for at in [*marked, int(tokens.mix(np.array([len(text) + k], np.uint64))[0] % tokens.U(b - a))]:
            low = max(0, min(at - WINDOW // 2, b - a - WINDOW))
            high = min(b - a, low + WINDOW)
            pad = WINDOW - (high - low)
            yield np.pad(f[:, a + low : a + high], ((0, 0), (0, pad))), np.pad(label[low:high], (0, pad), constant_values=-1)


_LOW, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_MIXED = _LOW + _LOW.upper() + _DIGIT
LAYOUTS = ['client_key = "{}"', "auth: {}", "pwd={}", "Authorization: Bearer {}", "export KEY='{}'", "credential {} was", "key is {} .", '"private_key": "{}",', "{}", "({})", "use {} to", "{},", "id {}"]


class Maker:
    """Random keys and harmless look-alikes, the same for the same seed."""

    def __init__(self, seed: int):
        self.draw = random.Random(seed)

    def pick(self, chars: str, low: int, high: int | None = None) -> str:
        return "".join(self.draw.choices(chars, k=low if high is None else self.draw.randint(low, high)))

    def one(self, values: list):
        return self.draw.choice(values)

    def word(self) -> str:
        """A word that could be spoken: consonants and vowels in turn."""
        return "".join(self.pick("bcdfghklmnprstvwz", 1) + self.pick("aeiou", 1) + (self.pick("lnrst", 1) if self.draw.random() < 0.3 else "") for _ in range(self.draw.randint(1, 4)))

    def key(self) -> str:
        """Random characters of one of several alphabets, alone or after prefixes, in groups, or in dotted parts."""
        chars = self.one([_MIXED, _MIXED, _LOW + _LOW.upper(), _MIXED + "+/", _LOW + _DIGIT, _LOW.upper() + _DIGIT, _MIXED + "_-", "0123456789abcdef"])
        kind = self.draw.randrange(6)
        if kind == 0:
            out = self.pick(_LOW, 2, 5) + self.one(["_", "-", "_" + self.pick(_LOW, 3, 5) + "_"]) + self.pick(chars, 18, 44)
        elif kind == 1:
            out = "-".join([self.pick(_LOW, 2, 5), *(self.pick(_DIGIT, 8, 13) for _ in range(self.draw.randint(1, 2))), self.pick(_MIXED, 16, 32)])
        elif kind == 2:
            out = ".".join(self.pick(_MIXED + "_-", 16, 60) for _ in range(self.draw.randint(2, 3)))
        elif kind == 3:
            out = self.pick(_MIXED + "+/", 20, 60) + self.one(["", "=", "=="])
        else:
            out = self.pick(chars, 16, 48)
        kinds = sum(any(c in chars for c in out) for chars in (_LOW, _LOW.upper(), _DIGIT))
        return out if kinds > 1 else out[:-2] + "7x"

    def decoy(self) -> str:
        w, d = self.word, lambda a, b=None: self.pick(_DIGIT, a, b)
        return self.one([
            lambda: f"https/{w()}.{w()}.com/{w()}/{d(4)}", lambda: "-".join(w() for _ in range(self.draw.randint(2, 5))), lambda: w() + w() + w(), lambda: f"+1-{d(3)}-555-{d(4)}",
            lambda: f"{d(3)}.{d(2)}.{d(3)}.{d(2)}", lambda: f"{w()}.{w()}@{w()}.com", lambda: f"v{d(1)}.{d(2)}.{d(1)}", lambda: f"20{d(2)}-0{d(1)}-1{d(1)}T0{d(1)}.{d(2)}", lambda: (w() + w()).upper(),
            lambda: "=" * self.draw.randint(4, 40), lambda: "-" * self.draw.randint(4, 40), lambda: "_" * self.draw.randint(4, 40), lambda: "_".join(w() for _ in range(self.draw.randint(2, 5))), lambda: "".join(w().capitalize() for _ in range(self.draw.randint(2, 4))),
            lambda: "/".join(w() for _ in range(self.draw.randint(2, 6))) + ".py", lambda: f"IMG_20{d(6)}_{d(6)}.jpg", lambda: d(5, 20), lambda: f"{w().upper()[:3]}-{d(3, 6)}", lambda: f"{w()}{d(1, 4)}", lambda: f"{w()}/{w()}_{d(1, 3)}.{w()}", lambda: f"{w().upper()}_{w().upper()}_{d(1, 2)}",
        ])()


def made_up(n: int = 3000, seed: int = 5, layouts: list[str] | None = None) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Texts with random keys in many layouts, and texts with harmless look-alikes."""
    make, layouts = Maker(seed), layouts or LAYOUTS
    texts, spans = [], []
    for _ in range(n):
        left, right = (" ".join(make.word() for _ in range(9)) for _ in range(2))
        lead, _, tail = make.one(layouts).partition("{}")
        key = make.draw.random() < 0.5
        what = make.key() if key else make.decoy()
        texts.append(f"{left} {lead}{what}{tail} {right}")
        at = len(left) + 1 + len(lead)
        spans.append([(at, at + len(what))] if key else [])
    return texts, spans


def hidden(texts: list[str]) -> tuple[list[str], list[list[tuple[int, int]]]]:
    """Around the patterns' secrets (WINDOWS of a text): their surroundings without the key word, and a made-up key in their place."""
    out, spans = [], []
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw, np.uint8)
        found, inner = base_spans(text, raw.translate(_LOWER), _hexes(data, np.array([0, len(data)]))[0])
        if not found:
            continue
        make = Maker(int(tokens.mix(np.array([len(text)], np.uint64))[0] >> tokens.U(32)))
        every = -(-len(found) // WINDOWS)
        for start, _, end in found[::every]:
            left, key = text[max(0, start - 150) : start], make.key()
            out.append(left + key + text[end : end + 150])
            spans.append([(len(left), len(left) + len(key))])
    return out, spans


def train(windows: list[tuple[np.ndarray, np.ndarray]], rounds: int = 12, rate: float = 0.2, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Weights (3 x TABLE) and transitions (3 x 3) by gradient ascent (Adagrad) on the windows' log-likelihood, batch by batch in a fixed order."""
    w, t = np.zeros((3, TABLE), np.float32), np.zeros((3, 3))
    if not windows:
        w[O] = 1
        return w, t
    draw = np.random.default_rng(11)
    all_f = np.stack([x for x, _ in windows]).transpose(1, 0, 2)  # features, windows, steps
    all_y = np.stack([x for _, x in windows])
    sum_w, sum_t = np.full((3, TABLE), 1e-6, np.float32), np.full((3, 3), 1e-6)
    soft = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    for _ in range(rounds):
        order = draw.permutation(len(all_y))
        for part in np.array_split(order, max(1, len(order) // batch)):
            f, y = all_f[:, part], all_y[part]
            mask = y >= 0
            y, size = np.maximum(y, 0), len(part)
            gold = np.eye(3)[y] * mask[..., None]
            pairs = mask[:, 1:] & mask[:, :-1]
            score = np.stack([row[f].sum(axis=0) for row in w], axis=-1) * mask[..., None]
            alpha, beta = score.astype(float), np.zeros(score.shape)
            for k in range(1, WINDOW):
                step = soft(alpha[:, k - 1, :, None] + t, 1) + score[:, k]
                alpha[:, k] = np.where(mask[:, k, None], step, alpha[:, k - 1])
            for k in reversed(range(WINDOW - 1)):
                step = soft(t + (score[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
                beta[:, k] = np.where(mask[:, k + 1, None], step, 0)
            total = soft(alpha[:, -1], 1)
            gamma = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
            edge = np.exp(alpha[:, :-1, :, None] + t + (score + beta)[:, 1:, None, :] - total[:, None, None, None]) * pairs[..., None, None]
            slope, flat = (gold - gamma).reshape(-1, 3), f.reshape(len(f), -1)
            for label in range(3):
                g = (np.bincount(flat.reshape(-1), weights=np.tile(slope[:, label], len(f)), minlength=TABLE) / size - 1e-6 * w[label]).astype(np.float32)
                sum_w[label] += g * g
                w[label] += rate * g / np.sqrt(sum_w[label])
            gold_t = np.zeros((3, 3))
            np.add.at(gold_t, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
            g = (gold_t - edge.sum(axis=(0, 1))) / size
            sum_t += g * g
            t += rate * g / np.sqrt(sum_t)
    return w, t


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Trains on the patterns' secrets in a sample of about ``sample`` distinct rows, and on made-up windows."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    share = min(1.0, sample / max(1, rows.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for i in range(0, len(texts), 200):
                made = [*_labelled(texts[i : i + 200]), *_labelled(*hidden(texts[i : i + 200]))]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes() for x, _ in made]), pa.array([y.astype(np.int8).tobytes() for _, y in made])], names=["f", "y"])

    # Rows are drawn where they are read; those that repeat share their mark.
    mark = F.xxhash64("key", "text").bitwiseAND(F.lit((1 << 63) - 1))
    chosen = rows.withColumn("mark", mark).where(F.col("mark").cast("double") < share * 2.0**63).dropDuplicates(["mark"]).select("text")
    got = chosen.mapInArrow(run, "f binary, y binary").distinct().toPandas()
    order = sorted(zip(got["f"], got["y"], strict=True))  # the same sums whatever order the tasks ended in
    windows = [(np.frombuffer(f, np.int32).reshape(-1, WINDOW), np.frombuffer(y, np.int8).astype(np.int64)) for f, y in order]
    return train([*windows, *_labelled(*made_up())] if windows else [])


def viterbi(score: np.ndarray, t: np.ndarray, left: bool, right: bool) -> list[int]:
    """The best labels of one run. left, right: whether an outside token stands there."""
    best = score[0] + (t[O] if left else 0)
    back = []
    for row in score[1:]:
        all_ = best[:, None] + t
        back.append(all_.argmax(axis=0))
        best = all_.max(axis=0) + row
    at = int(np.argmax(best + (t[:, O] if right else 0)))
    out = [at]
    for row in reversed(back):
        at = int(row[at])
        out.append(at)
    return out[::-1]


def tag(score: np.ndarray, first: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Viterbi labels (tokens) of documents whose first tokens are at ``first``."""
    label = np.zeros(len(score), np.int64)
    margin = 2 * (t.max() - t.min())
    open_ = np.flatnonzero(score[:, O] - np.maximum(score[:, B], score[:, I]) <= margin)
    if not len(open_):
        return label
    of = np.searchsorted(first, open_, "right") - 1
    new = np.concatenate([[True], (open_[1:] != open_[:-1] + 1) | (of[1:] != of[:-1])])
    for a, b, d in zip(open_[new], open_[np.concatenate([new[1:], [True]])] + 1, of[new], strict=True):
        label[a:b] = viterbi(score[a:b].astype(float), t, a > first[d], b < first[d + 1])
    return label


def scan(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", spans: str = "secret_spans") -> DataFrame:
    """``docs`` with its secrets: array of (kind, start, end), by start and kind; code points, end exclusive."""
    kept = docs.drop(spans)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            data, offsets = tokens.buffers(column)
            out: list[list[dict]] = []
            for i, j in tokens.slices(offsets):
                part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first, f = features(part, off)
                label = tag(np.stack([sum(row[x] for x in f) for row in w], axis=-1) if len(starts) else np.zeros((0, 3)), first, t)
                hexes = _hexes(part, off)
                marked = np.flatnonzero(label)
                bounds = np.searchsorted(marked, first)
                for k in range(j - i):
                    raw = part[off[k] : off[k + 1]]
                    lower = raw.tobytes().translate(_LOWER)
                    need = any(x in lower for x in (*WORDS, b"akia"))
                    found = base_spans(raw.tobytes().decode("utf-8", "surrogatepass") if need else "", lower, hexes[k])[0] if need or hexes[k] else []
                    at = marked[bounds[k] : bounds[k + 1]]
                    if len(at):
                        heads = np.flatnonzero((raw & 0xC0) != 0x80)
                        a, b = np.searchsorted(heads, starts[at] - off[k]), np.searchsorted(heads, ends[at] - off[k])
                        joined: list[list[int]] = []
                        for x, y, token, l in zip(a.tolist(), b.tolist(), at.tolist(), label[at].tolist(), strict=True):
                            if l == I and joined and joined[-1][2] == token - 1:
                                joined[-1][1:] = y, token
                            else:
                                joined.append([x, y, token])
                        base = merged(found)
                        found += [(x, 3, y) for x, y, _ in joined if not covered(x, y, base)]
                    out.append([{"kind": KINDS[c], "start": x, "end": y} for x, c, y in sorted(found)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, spans])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(spans, T.ArrayType(SPAN))]))


def redacted(text: F.Column, spans: F.Column, mark: str = "[SECRET]") -> F.Column:
    """``text`` with every span, and what overlaps it, replaced by ``mark``."""
    cut = F.aggregate(
        spans,
        F.struct(F.lit("").alias("kept"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(acc["kept"].alias("kept"), F.greatest(acc["at"], s["end"]).alias("at"))).otherwise(
            F.struct(F.concat(acc["kept"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("kept"), s["end"].alias("at"))
        ),
        lambda acc: F.concat(acc["kept"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def digest(spans: F.Column) -> tuple[F.Column, ...]:
    """n_assign, n_access, n_hex, base_sha256 and spans as text."""
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(text(F.filter(spans, lambda s: s["kind"] != "crf")).cast("binary"), 256)
    return *map(count, KINDS[:3]), base.alias("base_sha256"), text(spans).alias("spans")


