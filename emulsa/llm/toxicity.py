"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Each token is a word vector (words that the sample has in MIN_DOCS documents, the rest share one) and the mean of vectors of
its character n-grams (hashed). A GRU reads the text in both directions and gives each token a state; attention pools the
states of a window of WINDOW tokens, a logistic unit scores the window. All overlapping windows are scored, one from every
token on, and the highest is the document's score.

A token's state is read from the segment of WINDOW tokens that it is in and the whole segment before (forwards) or after
(backwards), so every state has WINDOW to 2 * WINDOW tokens of context, texts of any length are read in batches of equal
rows, and windows share the states of their tokens. Training, in numpy on the driver, is by the same maximum: in each epoch a
document gives the window that now scores highest (a toxic one) or that window and a random one (a clean one).

The sample is bounded: SAMPLE labelled rows of the learning folds (crc32(doc_id as text) mod 5 is not 0), toxic ones up to
half. Scoring is a pass over the texts in Arrow batches with the model (under 2 MB) as a closure.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pinned, table

#: The bound of the sample: rows, characters in all, characters of one text (longer ones teach nothing; all are scored).
SAMPLE, SAMPLE_CHARS, MAX_SAMPLE_CHARS, FOLDS = 2_000, 6_000_000, 300_000, 5
WINDOW = 32
#: Segments that are read at a time.
ROWS = 4096
D_WORD, D_CHAR, HIDDEN, BUCKETS = 12, 12, 8, 16384
MIN_DOCS, EPOCHS, BATCH, RATE, SEED = 4, 5, 64, 0.01, 7
PRIOR, DECAY = 4.0, 0.002
WORD = re.compile(r"[^\W_]+")
MAX_CHARS = 24


def tokens_of(text: str) -> list[str]:
    """Lower-case runs of letters and digits; longer ones in pieces of MAX_CHARS characters, each with the last two of the piece before, so that every 3-gram is in one."""
    step, words = MAX_CHARS - 2, WORD.findall(text.lower())
    if max(map(len, words), default=0) <= MAX_CHARS:
        return words
    return [p for w in words for p in ([w] if len(w) <= MAX_CHARS else [w[i : i + MAX_CHARS] for i in range(0, len(w) - 2, step)])]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's 3-grams, of its prefixes of 4 to 6 characters and of the whole, end to end, and where each word's begin. Words have MAX_CHARS characters at most, as tokens_of() gives them."""
    if not words:
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    marked = [f"<{w}>" for w in words]
    size = np.array(list(map(len, marked)))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(codes)) - first[of]
    powers = np.array([pow(1_000_003, k, 1 << 64) for k in range(MAX_CHARS + 2)], np.uint64)
    upto = np.cumsum(codes * powers[place])  # wraps; a difference is the sum of a part
    before = upto[first] - codes[first]
    tri = np.flatnonzero(place < size[of] - 2)
    found = [(of[tri], codes[tri] + codes[tri + 1] * powers[5] + codes[tri + 2] * powers[9])]
    for n in (4, 5, 6):
        k = np.flatnonzero(size >= n)
        found.append((k, upto[first[k] + n - 1] - before[k] + np.uint64(n)))
    found.append((np.arange(len(words)), upto[first + size - 1] - before + np.uint64(7)))
    owner, key = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    order = np.argsort(owner, kind="stable")
    key = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    return key[order].astype(np.int64), np.append(0, np.cumsum(np.bincount(owner, minlength=len(words))))


def _add_rows(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """out[rows] += values, where rows repeat."""
    if len(rows):
        order = np.argsort(rows, kind="stable")
        first = np.flatnonzero(np.diff(rows[order], prepend=-1))
        out[rows[order[first]]] += np.add.reduceat(values[order], first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Parameters by name; windows are arrays of ids into a table of the batch's distinct words."""

    def __init__(self, words: dict[str, int], rng: np.random.Generator):
        self.words = words
        n, d = len(words) + 1, D_WORD + D_CHAR
        r = lambda *shape, scale=0.1: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"word": r(n, D_WORD), "char": r(BUCKETS, D_CHAR), "v": r(2 * HIDDEN, scale=0.3), "c": np.zeros(1, np.float32), "a": r(2 * HIDDEN, scale=0.3)}
        for way in "fb":
            self.p |= {f"W{way}": r(d, 3 * HIDDEN, scale=0.3), f"U{way}": r(HIDDEN, 3 * HIDDEN, scale=0.3), f"B{way}": np.zeros(3 * HIDDEN, np.float32)}

    def index(self, vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: its row of "word" (0 if unknown); its buckets, end to end, and where each word's begin."""
        return np.array([self.words.get(w, 0) for w in vocabulary], np.int64), *grams(vocabulary)

    def inputs(self, index) -> np.ndarray:
        """A vector for each word, and a zero one for padding at the end."""
        rows, buckets, at = index
        out = np.zeros((len(rows) + 1, D_WORD + D_CHAR), np.float32)
        if len(rows):
            out[:-1, :D_WORD] = self.p["word"][rows]
            out[:-1, D_WORD:] = np.add.reduceat(self.p["char"][buckets], at[:-1], axis=0) / np.diff(at)[:, None]
        return out

    def states(self, x: np.ndarray, ids: np.ndarray, steps: dict | None = None) -> np.ndarray:
        """States (WINDOW, n, 2 * HIDDEN) of the middle third of ids (n, 3 * WINDOW); x: inputs() of the words. steps: gets what backward() needs."""
        n, width = ids.shape
        out = np.empty((WINDOW, n, 2 * HIDDEN), np.float32)
        real = ids < len(x) - 1
        for way in "fb":
            projected = x @ self.p[f"W{way}"] + self.p[f"B{way}"]
            u, h = self.p[f"U{way}"], np.zeros((n, HIDDEN), np.float32)
            u_zr, u_new = u[:, : 2 * HIDDEN], u[:, 2 * HIDDEN :]
            part = slice(0, HIDDEN) if way == "f" else slice(HIDDEN, None)
            for t in range(2 * WINDOW) if way == "f" else range(width - 1, WINDOW - 1, -1):
                g = projected[ids[:, t]]
                zr = _sigmoid(g[:, : 2 * HIDDEN] + h @ u_zr)
                z, r = zr[:, :HIDDEN] * real[:, t, None], zr[:, HIDDEN:]  # padding changes no state
                new = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ u_new)
                if steps is not None:
                    steps[way, t] = (h, z, r, new)
                h = h + z * (new - h)
                if WINDOW <= t < 2 * WINDOW:
                    out[t - WINDOW, :, part] = h
        return out

    def forward(self, x: np.ndarray, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Scores of the windows in the middle third of ids (n, 3 * WINDOW)."""
        steps = {} if keep is not None else None
        states = self.states(x, ids, steps)
        real = (ids[:, WINDOW : 2 * WINDOW] < len(x) - 1).T
        w = np.exp(np.clip(states @ self.p["a"], -30, 30)) * real
        w /= np.maximum(w.sum(axis=0), 1e-30)
        pooled = np.einsum("tn,tnk->nk", w, states)
        if keep is not None:
            keep += [states, steps, w, pooled]
        return _sigmoid(pooled @ self.p["v"] + self.p["c"][0])

    def backward(self, x: np.ndarray, ids: np.ndarray, index, kept: list, d_logit: np.ndarray) -> dict[str, np.ndarray]:
        states, steps, w, pooled = kept
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["v"], g["c"][0] = pooled.T @ d_logit, d_logit.sum()
        d_pooled = d_logit[:, None] * self.p["v"]
        d_w = np.einsum("nk,tnk->tn", d_pooled, states)
        d_e = w * (d_w - (w * d_w).sum(axis=0))
        g["a"] = np.einsum("tn,tnk->k", d_e, states)
        d_states = w[:, :, None] * d_pooled + d_e[:, :, None] * self.p["a"]
        d_x = np.zeros_like(x)
        width = ids.shape[1]
        for way in "fb":
            u, part = self.p[f"U{way}"], slice(0, HIDDEN) if way == "f" else slice(HIDDEN, None)
            d_projected, d_h, d_gates = np.zeros((len(x), 3 * HIDDEN), np.float32), np.zeros((ids.shape[0], HIDDEN), np.float32), []
            places = range(2 * WINDOW - 1, -1, -1) if way == "f" else range(WINDOW, width)
            for t in places:
                h, z, r, new = steps[way, t]
                if WINDOW <= t < 2 * WINDOW:
                    d_h = d_h + d_states[t - WINDOW, :, part]
                d_new, d_z = d_h * z * (1 - new**2), d_h * (new - h) * z * (1 - z)
                d_rh = d_new @ u[:, 2 * HIDDEN :].T
                d_r = d_rh * h * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], axis=1)
                g[f"U{way}"][:, : 2 * HIDDEN] += h.T @ d_zr
                g[f"U{way}"][:, 2 * HIDDEN :] += (r * h).T @ d_new
                d_gates.append(np.concatenate([d_zr, d_new], axis=1))
                d_h = d_h * (1 - z) + d_rh * r + d_zr @ u[:, : 2 * HIDDEN].T
            _add_rows(d_projected, ids[:, list(places)].T.ravel(), np.concatenate(d_gates))
            g[f"W{way}"], g[f"B{way}"] = x.T @ d_projected, d_projected.sum(axis=0)
            d_x += d_projected @ self.p[f"W{way}"].T
        rows, buckets, at = index
        _add_rows(g["word"], rows, d_x[:-1, :D_WORD])
        _add_rows(g["char"], buckets, np.repeat(d_x[:-1, D_WORD:] / np.diff(at)[:, None], np.diff(at), axis=0))
        return g


class Laid:
    """Documents side by side: each begins on a segment of WINDOW tokens and is filled up with padding."""

    def __init__(self, model: Model, docs: list[list[str]]):
        ids: dict[str, int] = {}
        coded = [np.array([ids.setdefault(w, len(ids)) for w in d], np.int64) for d in docs]
        self.index, self.pad = model.index(list(ids)), len(ids)
        self.n = np.array(list(map(len, coded)), np.int64)
        self.segments = np.maximum(1, -(-self.n // WINDOW))
        self.at = np.cumsum(self.segments * WINDOW) - self.segments * WINDOW
        self.tokens = np.full(int(self.segments.sum()) * WINDOW, self.pad, np.int64)
        for a, c in zip(self.at.tolist(), coded, strict=True):
            self.tokens[a : a + len(c)] = c
        #: Of each document the last place where a window begins.
        self.last = self.at + np.maximum(0, self.n - WINDOW)

    def around(self, starts: np.ndarray, of: np.ndarray) -> np.ndarray:
        """For windows that begin at starts, in documents of: their tokens with WINDOW tokens on either side, padding outside the document."""
        place = starts[:, None] + np.arange(-WINDOW, 2 * WINDOW)
        inside = (place >= self.at[of][:, None]) & (place < (self.at + self.n)[of][:, None])
        return np.where(inside, self.tokens[np.where(inside, place, 0)], self.pad)

    def logits(self, model: Model) -> np.ndarray:
        """Of the window that begins at each place; minus infinity where none does."""
        x, of = model.inputs(self.index), np.repeat(np.arange(len(self.n)), self.segments)
        weight, value = np.zeros(len(self.tokens) + WINDOW, np.float32), np.zeros(len(self.tokens) + WINDOW, np.float32)
        for lo in range(0, len(of), ROWS):
            ids = self.around(np.arange(lo, min(lo + ROWS, len(of))) * WINDOW, of[lo : lo + ROWS])
            states = model.states(x, ids).transpose(1, 0, 2).reshape(-1, 2 * HIDDEN)
            part = slice(lo * WINDOW, lo * WINDOW + len(states))
            weight[part] = np.exp(np.clip(states @ model.p["a"], -30, 30)) * (self.tokens[part] < self.pad)
            value[part] = weight[part] * (states @ model.p["v"])
        sums = lambda y: np.lib.stride_tricks.sliding_window_view(y, WINDOW)[: len(self.tokens)].sum(axis=1)
        out = sums(value) / np.maximum(sums(weight), 1e-30) + model.p["c"][0]
        out[np.arange(len(out)) > np.repeat(self.last, self.segments * WINDOW)] = -np.inf
        return out


class Scorer:
    """Scores of whole documents."""

    def __init__(self, model: Model):
        self.model = model

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0, np.float32)
        laid = Laid(self.model, [tokens_of(t) for t in texts])
        return _sigmoid(np.maximum.reduceat(laid.logits(self.model), laid.at))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """The network fitted to labelled texts (Adam on the logistic loss, classes weighed evenly)."""
    rng = np.random.default_rng(seed)
    docs = [tokens_of(t) for t in texts]
    y = np.array(labels, np.float32)
    frequent = Counter(w for d in docs for w in set(d))
    model = Model({w: k + 1 for k, w in enumerate(sorted(w for w, n in frequent.items() if n >= MIN_DOCS))}, rng)
    if not docs:
        return model
    # Words begin with how much oftener toxic documents have them: a start, not a verdict.
    toxic, clean = Counter(w for d, l in zip(docs, labels, strict=True) if l for w in set(d)), Counter(w for d, l in zip(docs, labels, strict=True) if not l for w in set(d))
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    # Rare ones are held near zero.
    odds = lambda a, b: np.log((a + PRIOR * n1 / (n1 + n0)) / n1) - np.log((b + PRIOR * n0 / (n1 + n0)) / n0)
    for w, k in model.words.items():
        model.p["word"][k, 0] = np.clip(odds(toxic[w], clean[w]), -3, 5) / 3
    by_gram1, by_gram0 = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for d, l in zip(docs, labels, strict=True):
        (by_gram1 if l else by_gram0)[np.unique(grams(list(set(d)))[0])] += 1
    model.p["char"][:, 0] = np.clip(odds(by_gram1, by_gram0), -3, 5) / 3
    laid = Laid(model, docs)
    weight = np.where(y > 0, len(y) / (2 * n1), len(y) / (2 * n0)).astype(np.float32)
    m1, m2, step = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    peak = lambda told: np.array([a + int(told[a : a + max(1, n)].argmax()) for a, n in zip(laid.at, laid.n, strict=True)])
    for epoch in range(epochs):
        if epoch:
            best = peak(laid.logits(model))
        else:  # around the most telling word
            x = model.inputs(laid.index)
            best = np.clip(peak(np.append(x[:-1, 0] + x[:-1, D_WORD], -9)[laid.tokens]) - WINDOW // 2, laid.at, laid.last)
        other = laid.at + (rng.random(len(docs)) * (laid.last - laid.at + 1)).astype(int)
        chosen, of = np.concatenate([best, other[y == 0]]), np.concatenate([np.arange(len(docs)), np.flatnonzero(y == 0)])
        targets, weights = np.concatenate([y, y[y == 0]]), np.concatenate([weight, weight[y == 0] / 2])
        order = rng.permutation(len(chosen))
        for lo in range(0, len(order), BATCH):
            k = order[lo : lo + BATCH]
            some, back = np.unique(laid.around(chosen[k], of[k]), return_inverse=True)
            some, back = (some[:-1], back) if some[-1] == laid.pad else (some, back)  # padding comes last, as in inputs()
            index = laid.index
            part_index = (index[0][some], np.concatenate([index[1][index[2][i] : index[2][i + 1]] for i in some]) if len(some) else index[1][:0], np.cumsum([0, *(index[2][some + 1] - index[2][some])]))
            part_ids, kept = back.reshape(len(k), 3 * WINDOW), []
            x = model.inputs(part_index)
            p = model.forward(x, part_ids, kept)
            grads = model.backward(x, part_ids, part_index, kept, ((p - targets[k]) * weights[k] / len(k)).astype(np.float32))
            step += 1
            rate = RATE * (1 - 0.8 * epoch / epochs)
            for name, g in grads.items():
                m1[name] = 0.9 * m1[name] + 0.1 * g
                m2[name] = 0.99 * m2[name] + 0.01 * g * g
                if name in ("word", "char"):
                    model.p[name] *= 1 - DECAY
                model.p[name] -= rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.99**step)) + 1e-6)
    return model


def learning_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most sample labelled rows outside fold 0, at most half of them toxic if there are as many others.

    Taken in order of a hash of doc_id: rows of each label up to the number, then, of those, texts of up to MAX_SAMPLE_CHARS
    characters that still fit into SAMPLE_CHARS. A doc_id that is labelled twice is toxic if one label says so; of several
    texts of one doc_id the first in alphabetical order counts. Null doc_ids, labels and texts, and labels other than 0 and 1, teach nothing.
    """
    labels = pinned(labels, {"doc_id": "bigint", "toxic": "int"}).filter("toxic in (0, 1) and doc_id is not null").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)
    labels, picked = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), None
    for kind, n in ((1, sample // 2), (0, sample - sample // 2)):
        some = labels.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = some if picked is None else picked.unionByName(some)
    rows = pinned(docs, {"doc_id": "bigint", "text": "string"}).join(F.broadcast(picked), "doc_id").withColumn("n", F.length("text")).filter(F.col("n") <= MAX_SAMPLE_CHARS)
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "n")).alias("t")).select("doc_id", "toxic", "t.*")
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # sample rows at most
    rows = rows.withColumn("upto", F.sum("n").over(before)).filter(F.col("upto") <= SAMPLE_CHARS).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def score(docs: DataFrame, model: Model, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score (double), predicted (int) of every row.

    Null texts are empty and score like one without words. Rows without doc_id are not held out. Repeated rows give repeated
    rows; an empty table gives an empty result; other columns are ignored.
    """
    scorer = Scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                hi, size = lo, 0
                while hi < batch.num_rows and (hi == lo or size < 1_000_000):
                    size += len(batch.column(1)[hi].as_py() or "")
                    hi += 1
                ids, texts = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo).to_pylist()
                s = scorer.scores([t or "" for t in texts]).astype(np.float64)
                held = [x is not None and crc32(str(x).encode()) % folds == 0 for x in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(held), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
                lo = hi

    return pinned(docs, {"doc_id": "bigint", "text": "string"}).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learns from the labelled rows outside fold 0 and scores every row of docs. Without labels of both kinds all score as the untrained network does."""
    return score(docs, train(*learning_sample(docs, labels, sample)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
