"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters and digits, chains are lines, states are clean and
toxic.  Document labels become token labels through contexts: a token of a toxic
document is labelled toxic if its word or one of its prefixes keeps occurring in
new contexts (neighbouring words) of toxic documents and hardly ever in clean
ones; counting contexts and not rows keeps copied documents from counting twice.
The field's emissions (word, prefixes, suffix) and transitions are then fitted by
maximum likelihood, and forward-backward marginals give spans and scores.

A document's score comes from its marginals: the largest, their sum and the number
of tokens go through a logistic output fitted on the sample, weighed to the share of
toxic labels in the whole label table.  So one doubtful word is not enough, many are.
Null and empty texts have no token and score 0.  Rows are scored one by one, so ties, repeated rows and extra
columns don't matter; without labelled rows of both classes all scores are 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import held_out, id_text, tidy
from quantloom.llm.samples import labelled_sample, share_of
from quantloom.llm.textkernel import NOT_WORD, U64, Hasher, Slice, Words, lowered, mix, slices, stream, words

THRESHOLD = 0.3
#: Rows of label 0 and 1 in the fitting sample: clean text is what sets apart chance from cause.
SAMPLE = (2400, 900)
#: Longest text of the sample, in characters.
LONGEST = 12_000
PREFIXES = (4, 5, 6, 7, 8)
SUFFIX = 4
#: Contexts of clean documents that a toxic word may have for each one of toxic documents.
MOST_CLEAN = 0.25
_KIND = stream(2 + len(PREFIXES), 21)
_BITS = 22


def token_features(part: Slice) -> tuple[Words, np.ndarray]:
    """Tokens of a slice and a (token, feature kind) matrix of feature hashes; 0: none."""
    found = words(part, NOT_WORD)
    low = lowered(part.data, latin=True)
    hasher = Hasher(low)
    size = found.ends - found.starts
    columns = [hasher.ranges(found.starts, found.ends) ^ _KIND[0]]
    for j, k in enumerate(PREFIXES):
        column = hasher.ranges(found.starts, np.minimum(found.starts + k, found.ends)) ^ _KIND[1 + j]
        column[size < k] = 0
        columns.append(column)
    column = hasher.ranges(np.maximum(found.ends - SUFFIX, found.starts), found.ends) ^ _KIND[-1]
    column[size <= SUFFIX] = 0
    columns.append(column)
    return found, np.stack(columns, axis=1) if len(found.starts) else np.zeros((0, len(columns)), dtype=U64)


def chains(part: Slice, found: Words) -> np.ndarray:
    """For each token the number of its chain: lines, which no chain crosses."""
    breaks = np.zeros(len(part.data) + 1, dtype=np.int64)
    np.cumsum(part.data == 0x0A, out=breaks[1:])
    line = breaks[found.starts] + found.doc
    fresh = np.ones(len(line), dtype=bool)
    fresh[1:] = line[1:] != line[:-1]
    return np.cumsum(fresh) - 1


@dataclass
class Field:
    """Emission weights of known features (sorted hashes), bias and transitions."""

    known: np.ndarray
    weight: np.ndarray
    bias: float
    move: np.ndarray  # (2, 2) transition scores
    output: np.ndarray | None = None  # weights of a document's measures

    def __post_init__(self):
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[(self.known >> U64(64 - _BITS)).astype(np.int64)] = True

    def emissions(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of the toxic state for each token, and which tokens have evidence."""
        out = np.full(len(features), self.bias)
        hit = np.zeros(len(features), dtype=bool)
        if not len(self.known):
            return out, hit
        for j in range(features.shape[1]):
            maybe = np.flatnonzero(self.seen[(features[:, j] >> U64(64 - _BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.known, features[maybe, j]), len(self.known) - 1)
            right = self.known[at] == features[maybe, j]
            out[maybe[right]] += self.weight[at[right]]
            hit[maybe[right]] = True
        return out, hit


def marginals(score: np.ndarray, chain: np.ndarray, move: np.ndarray, pairs: bool = False):
    """P(toxic) of each token by forward-backward over all chains at once.

    Chains are laid out by descending length, so step t works on those that
    still have a token t.  ``pairs`` adds the expected transition counts.
    """
    n = len(score)
    if not n:
        return (np.zeros(0), np.zeros((2, 2)), 0.0) if pairs else np.zeros(0)
    first = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]])
    size = np.diff(np.r_[first, n])
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    toxic = np.exp(np.clip(score, -30, 30))
    t = np.exp(move)
    alpha, scale = np.empty((n, 2)), np.empty(n)
    for step, k in enumerate(active):
        i = first[:k] + step
        if step:
            a = alpha[i - 1] @ t
        else:
            a = np.ones((k, 2))
        a[:, 1] *= toxic[i]
        scale[i] = a.sum(1)
        alpha[i] = a / scale[i][:, None]
    beta = np.ones((n, 2))
    counts = np.zeros((2, 2))
    for step in range(len(active) - 1, 0, -1):
        i = first[: active[step]] + step
        b = beta[i].copy()
        b[:, 1] *= toxic[i]
        b /= scale[i][:, None]
        beta[i - 1] = b @ t.T
        if pairs:
            counts += alpha[i - 1].T @ b * t
    p = alpha[:, 1] * beta[:, 1]
    return (p, counts, float(np.log(scale).sum())) if pairs else p


def fit(sample: list[tuple[str, int]], rounds: int = 60, rate: float = 0.3, decay: float = 2e-4) -> Field:
    """Learn token labels from contexts, then the field by maximum likelihood."""
    empty = Field(np.zeros(0, dtype=U64), np.zeros(0), -20.0, np.zeros((2, 2)))
    if len({label for _, label in sample}) < 2:
        return empty
    feats, line, doc, context = [], [], [], []
    seen_docs = seen_lines = 0
    for part in slices(pa.array([t for t, _ in sample], pa.string()), 1 << 18):
        found, f = token_features(part)
        if len(f):
            c = chains(part, found)
            w = f[:, 0]
            left, right = np.r_[U64(1), w[:-1]], np.r_[w[1:], U64(1)]
            feats.append(f)
            line.append(c + seen_lines)
            doc.append(found.doc + seen_docs)
            context.append(mix(left * U64(3) + w) + right)
            seen_lines += int(c[-1]) + 1
        seen_docs += len(part)
    if not feats:
        return empty
    feats = np.concatenate(feats)
    line, doc = np.concatenate(line).astype(np.int32), np.concatenate(doc).astype(np.int32)
    context = np.concatenate(context)
    bad = np.array([label for _, label in sample], dtype=bool)[doc]
    once = np.unique(context * U64(2) + bad, return_index=True)[1]
    total = np.array([(~bad[once]).sum(), bad[once].sum()], dtype=float)
    share = total[1] / total.sum()
    lexicon = []
    for j in range(feats.shape[1] - 1):  # words and prefixes
        names, code = np.unique(feats[once, j], return_inverse=True)
        code = code.astype(np.int32)
        in_bad, in_good = np.bincount(code, bad[once]), np.bincount(code, ~bad[once])
        pairs = np.unique(code[bad[once]].astype(np.int64) * (seen_docs + 1) + doc[once][bad[once]])
        docs_bad = np.bincount(pairs // (seen_docs + 1), minlength=len(names))
        # log-likelihood ratio against chance, with room for the number of names tried
        n = in_bad + in_good
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(in_bad > 0, in_bad * np.log(in_bad / (n * share)), 0.0) + np.where(in_good > 0, in_good * np.log(in_good / (n * (1 - share))), 0.0)
        lexicon.append(names[(docs_bad >= 3) & (gain >= np.log(len(names)) + 1) & (in_good <= MOST_CLEAN * in_bad) & (names != 0)])
    toxic = np.zeros(len(feats), dtype=bool)
    for j, names in enumerate(lexicon):
        toxic |= np.isin(feats[:, j], names)
    toxic &= bad
    if not toxic.any():
        return empty
    known = np.unique(feats[toxic])
    known = known[known != 0]
    # chains with a toxic token, all others that share a feature with one, and some more in hash order
    shares = np.zeros(len(feats), dtype=bool)
    for j in range(feats.shape[1] - 1):
        shares |= np.isin(feats[:, j], known)
    lines = np.unique(line)
    marked, close = np.isin(lines, line[toxic]), np.isin(lines, line[shares])
    others = lines[~marked & ~close]
    others = others[np.argsort(mix(others.astype(U64) + U64(5)))][: 2 * int(marked.sum()) + 200]
    # lines of toxic documents without a labelled token may hold unlabelled ones: they teach nothing
    unsure = np.unique(line[bad])
    use = np.isin(line, np.r_[lines[marked], np.setdiff1d(lines[close & ~marked], unsure), np.setdiff1d(others, unsure)])
    feats_used, y, chain = feats[use], toxic[use], line[use]
    at = np.minimum(np.searchsorted(known, feats_used), len(known) - 1)
    is_known = known[at] == feats_used
    token, kind = np.nonzero(is_known)
    feature = at[token, kind]
    first = np.r_[True, chain[1:] != chain[:-1]]
    inner = np.flatnonzero(~first)
    wanted = np.zeros((2, 2))
    np.add.at(wanted, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    theta = np.zeros(len(known) + 5)
    theta[-5] = -4.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        score = np.full(len(y), theta[-5])
        np.add.at(score, token, theta[feature])
        p, counts, _ = marginals(score, chain, theta[-4:].reshape(2, 2), pairs=True)
        error = y - p
        gradient = np.empty_like(theta)
        gradient[: len(known)] = np.bincount(feature, error[token], minlength=len(known))
        gradient[-5] = error.sum()
        gradient[-4:] = (wanted - counts).ravel()
        gradient = gradient - decay * len(y) * np.r_[theta[:-5] * 0.02, np.zeros(5)]
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    keep = np.abs(theta[:-5]) > 0.05
    return Field(known[keep], theta[:-5][keep], float(theta[-5]), theta[-4:].reshape(2, 2).copy())


def score_slice(part: Slice, field: Field) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Score of each text, and its toxic spans as (byte start, byte end, marginal)."""
    measures, count, spans = measure_slice(part, field)
    scores = np.zeros(len(part))
    if field.output is not None:
        scores[count > 0] = 1 / (1 + np.exp(-np.clip(measures[count > 0] @ field.output, -30, 30)))
    return scores, spans


N_MEASURES = 4


def measure_slice(part: Slice, field: Field) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, float]]]]:
    """For each text: log odds of the largest marginal, log of their sum, log of the tokens, 1; tokens; toxic spans."""
    n = len(part)
    spans: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
    found, feats = token_features(part)
    rest = 1 / (1 + np.exp(-np.clip(field.bias, -30, 30)))
    most, total = np.full(n, rest), np.zeros(n)
    if len(feats):
        emission, hit = field.emissions(feats)
        chain = chains(part, found)
        # a chain without evidence can't hold a span: only the others need the recursion
        use = np.isin(chain, chain[hit])
        if use.any():
            p = marginals(emission[use], chain[use], field.move)
            tokens = np.flatnonzero(use)
            np.maximum.at(most, found.doc[tokens], p)
            total = np.bincount(found.doc[tokens], np.where(hit[tokens], p, 0.0), minlength=n)
            for i, chance in zip(tokens[p >= 0.5], p[p >= 0.5], strict=True):
                own = spans[found.doc[i]]
                at = int(part.offsets[found.doc[i]])
                start, end = int(found.starts[i]) - at, int(found.ends[i]) - at
                if own and chain[i] == own[-1][3] and i == own[-1][4] + 1:
                    own[-1] = (own[-1][0], end, max(own[-1][2], float(chance)), chain[i], i)
                else:
                    own.append((start, end, float(chance), chain[i], i))
    most = np.clip(most, 1e-6, 1 - 1e-6)
    measures = np.stack([np.log(most / (1 - most)), np.log(total + 1e-2), np.log1p(found.count) / 4, np.ones(n)], axis=1)
    return measures, found.count, [[s[:3] for s in own] for own in spans]


def fit_output(sample: list[tuple[str, int]], field: Field, share: float, rounds: int = 40, decay: float = 1e-2) -> np.ndarray:
    """Logistic weights of a document's measures by Newton's method; rows weighed so that ``share`` of them are toxic."""
    rows = [measure_slice(part, field)[0] for part in slices(pa.array([t for t, _ in sample], pa.string()), 1 << 18)]
    x, y = np.concatenate(rows), np.array([label for _, label in sample], dtype=float)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w = np.zeros(N_MEASURES)
    ridge = decay * np.diag([1.0] * (N_MEASURES - 1) + [0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge + 1e-9 * np.eye(N_MEASURES)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge @ w)
        w = w + step / max(1.0, float(np.abs(step).max()))
    return w


SPANS = "array<struct<start:int,end:int,p:double>>"


def tag_toxicity(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, spans (code-point offsets, end exclusive) of every text."""
    shipped = docs.sparkSession.sparkContext.broadcast(field)  # bounded by the sample

    def run(batches):
        model = shipped.value
        for batch in batches:
            scores, spans = [], []
            for part in slices(batch.column(1)):
                s, found = score_slice(part, model)
                scores.append(s)
                for i, own in enumerate(found):
                    if own:
                        raw = part.data[part.offsets[i] : part.offsets[i + 1]]
                        place = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
                        own = [{"start": int(place[a]), "end": int(place[b]), "p": p} for a, b, p in own]
                    spans.append(own)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    return id_text(docs).mapInArrow(tidy(run), f"doc_id long, score double, spans {SPANS}")


def learn(docs: DataFrame, labels: DataFrame) -> Field:
    """The field and its output, from the bounded sample and the share of toxic labels."""
    sample = labelled_sample(docs, labels, "toxic", SAMPLE, LONGEST)
    field = fit(sample)
    if len({label for _, label in sample}) == 2:
        field.output = fit_output(sample, field, share_of(labels, "toxic"))
    return field


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on the labelled sample and score all documents."""
    return tag_toxicity(docs, learn(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), "spans",
    )
