"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Each passage is encoded
by measures of its bytes and words and a small dense layer; gated attention
(a tanh branch times a sigmoid branch) weighs the passages; the weighted mean
goes through a logistic output.  Only document labels are used, all parameters
are fitted together by Adam on the bounded sample.

Null and empty texts are one passage without words.  Every passage of a text is
encoded, whatever its length.  Rows are scored one by one, so ties, repeated
rows and extra columns don't matter; without labelled rows of both classes all
scores are 1 (nothing is rejected for lack of labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import held_out, id_text, tidy
from quantloom.llm.samples import labelled_sample
from quantloom.llm.textkernel import LOWER, Hasher, Slice, slices, words

THRESHOLD = 0.7
PASSAGE = 64

_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_SMALL = np.zeros(256, dtype=bool)
_SMALL[97:123] = True
_HIGH = np.zeros(256, dtype=bool)
_HIGH[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in "#*$%&<>=~^_@{}[]\\/"]] = True
_BAR = np.zeros(256, dtype=bool)
_BAR[ord("|")] = True
_SHOUT = np.zeros(256, dtype=bool)
_SHOUT[[ord("!"), ord("?")]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".,;:"]] = True
_LINE = np.zeros(256, dtype=bool)
_LINE[0x0A] = True
CLASSES = (_UPPER, _SMALL, _HIGH, _DIGIT, _MARK, _BAR, _SHOUT, _STOP, _LINE)
N_FEATURES = len(CLASSES) + 6


def encode(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Passage measures of a slice and the text each passage belongs to."""
    found = words(part)
    n = len(part)
    if len(found.starts):
        first_word = np.r_[0, np.cumsum(found.count)[:-1]]
        rank = np.arange(len(found.starts)) - first_word[found.doc]
        opens = np.flatnonzero(rank % PASSAGE == 0)
        size = np.diff(np.r_[opens, len(found.starts)])
        last = opens + size - 1
        start, end = found.starts[opens], found.ends[last]
        length = (end - start).astype(float)
        columns = []
        for kind in CLASSES:
            sums = np.zeros(len(part.data) + 1, dtype=np.int32)
            np.cumsum(kind[part.data], out=sums[1:])
            columns.append((sums[end] - sums[start]) / length)
        hashed = Hasher(LOWER[part.data]).ranges(found.starts, found.ends)
        passage = np.repeat(np.arange(len(opens)), size)
        keyed = (hashed >> np.uint64(24)) | (passage.astype(np.uint64) << np.uint64(40))
        ordered = np.sort(keyed)
        fresh = np.r_[True, ordered[1:] != ordered[:-1]]
        distinct = np.bincount((ordered[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(opens)) if len(opens) < 1 << 24 else size
        twin = np.r_[False, (hashed[1:] == hashed[:-1]) & (passage[1:] == passage[:-1])]
        columns += [
            distinct / size, np.bincount(passage, twin, minlength=len(opens)) / size, (found.ends - found.starts).astype(float).cumsum()[last] / size,
            np.log1p(size) / 4, np.log1p(found.count[found.doc[opens]]) / 8, np.ones(len(opens)),
        ]
        lengths = np.add.reduceat((found.ends - found.starts).astype(float), opens)
        columns[len(CLASSES) + 2] = lengths / size / 10
        matrix, bag = np.stack(columns, axis=1), found.doc[opens]
    else:
        matrix, bag = np.zeros((0, N_FEATURES)), np.zeros(0, dtype=np.int64)
    bare = np.flatnonzero(found.count == 0)
    if len(bare):
        matrix, bag = np.concatenate([matrix, np.zeros((len(bare), N_FEATURES))]), np.concatenate([bag, bare])
        order = np.argsort(bag, kind="stable")
        matrix, bag = matrix[order], bag[order]
    assert n == 0 or len(np.unique(bag)) == n
    return matrix, bag


@dataclass
class Model:
    """Standardisation, encoder (w, b), attention (v, u, a) and output (o, c)."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, {}
        f["x"] = np.clip((x - self.mean) / self.scale, -6, 6)
        f["z"] = np.tanh(f["x"] @ p["w"] + p["b"])
        f["t"] = np.tanh(f["z"] @ p["v"])
        f["g"] = 1 / (1 + np.exp(-(f["z"] @ p["u"])))
        f["first"] = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]]) if len(bag) else np.zeros(0, dtype=np.int64)
        own = np.cumsum(np.r_[True, bag[1:] != bag[:-1]]) - 1 if len(bag) else np.zeros(0, dtype=np.int64)
        f["own"] = own
        e = (f["t"] * f["g"]) @ p["a"]
        e = np.exp(e - np.maximum.reduceat(e, f["first"])[own])
        f["attention"] = e / np.add.reduceat(e, f["first"])[own]
        f["bag"] = np.add.reduceat(f["attention"][:, None] * f["z"], f["first"])
        f["y"] = 1 / (1 + np.exp(-np.clip(f["bag"] @ p["o"] + p["c"], -30, 30)))
        return f

    def gradients(self, f: dict[str, np.ndarray], error: np.ndarray) -> dict[str, np.ndarray]:
        """Of each parameter, from the derivative of the loss by each text's logit."""
        p = self.p
        g = {"o": f["bag"].T @ error, "c": error.sum()}
        d_bag = error[:, None] * p["o"]
        own, att = f["own"], f["attention"]
        d_att = (d_bag[own] * f["z"]).sum(1)
        d_e = att * (d_att - np.add.reduceat(att * d_att, f["first"])[own])
        tg = f["t"] * f["g"]
        g["a"] = tg.T @ d_e
        d_t, d_g = d_e[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2), d_e[:, None] * p["a"] * tg * (1 - f["g"])
        g["v"], g["u"] = f["z"].T @ d_t, f["z"].T @ d_g
        d_z = att[:, None] * d_bag[own] + d_t @ p["v"].T + d_g @ p["u"].T
        d_z = d_z * (1 - f["z"] ** 2)
        g["w"], g["b"] = f["x"].T @ d_z, d_z.sum(0)
        return g

    def score(self, part: Slice) -> np.ndarray:
        x, bag = encode(part)
        return self.forward(x, bag)["y"] if len(bag) else np.zeros(0)


def fit(sample: list[tuple[str, int]], width: int = 12, rounds: int = 400, rate: float = 0.02, decay: float = 1e-4) -> Model | None:
    if len({label for _, label in sample}) < 2:
        return None
    xs, bags, at = [], [], 0
    for part in slices(pa.array([t for t, _ in sample], pa.string()), 1 << 18):
        x, bag = encode(part)
        xs.append(x)
        bags.append(bag + at)
        at += len(part)
    x, bag = np.concatenate(xs), np.concatenate(bags)
    y = np.array([label for _, label in sample], dtype=float)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    scale = x.std(0)
    draw = np.random.default_rng(7)
    p = {
        "w": draw.normal(0, 0.3, (x.shape[1], width)), "b": np.zeros(width), "v": draw.normal(0, 0.3, (width, width)),
        "u": draw.normal(0, 0.3, (width, width)), "a": draw.normal(0, 0.3, width), "o": draw.normal(0, 0.3, width), "c": np.zeros(()),
    }
    model = Model(x.mean(0), np.where(scale > 1e-9, scale, 1.0), p)
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for step in range(1, rounds + 1):
        f = model.forward(x, bag)
        g = model.gradients(f, (f["y"] - y) * weight / len(y))
        for k in p:
            grad = g[k] + decay * p[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def scores(batches, model: Model | None):
    """(batch, score of each row): the texts are in the column named ``text``."""
    for batch in batches:
        column = batch.column(batch.schema.names.index("text"))
        if model is None:
            yield batch, np.ones(len(batch))
        else:
            found = [model.score(part) for part in slices(column)]
            yield batch, np.concatenate(found) if found else np.zeros(0)


def fitted(docs: DataFrame, labels: DataFrame) -> Model | None:
    return fit(labelled_sample(docs, labels, "quality"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))  # a few kilobytes

    def run(batches):
        for batch, found in scores(batches, shipped.value):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return id_text(docs).mapInArrow(tidy(run), "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with all their columns; no shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(batches):
        for batch, found in scores(batches, shipped.value):
            yield batch.filter(pa.array(found >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
