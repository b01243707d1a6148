"""Personal data: base patterns, and a span classifier taught by voting labelers.

Base kinds (email, ip, card, phone) are exact patterns and always stay.  Beyond
them, candidates (long codes and long numbers that no base span covers) get
votes from labelers: a shape pattern, a checksum, a gazetteer of key words and
issuer prefixes, the context before the span.  Votes and coarse features of all
documents are counted by Spark; expectation-maximisation over the counts (one
reliability for each labeler and class) gives a probability for each vote
pattern, on which a logistic classifier over the features is trained.  Candidates
it accepts become spans of kind ``secret`` or ``number``.

A match never leaves a run of the bytes its pattern can hold, so only such runs
with the pattern's trigger are searched.  Null and empty texts have no span.
Rows are independent: ties, repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import id_text, tidy
from quantloom.llm.textkernel import Slice, slices

# The base patterns.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(BASE)
_COMPILED = {k: re.compile(p) for k, p in BASE.items()}

# Words that announce a code or a number, in four languages.
CONTEXT_WORDS = (
    "token", "key", "secret", "password", "passwort", "passwd", "pwd", "bearer", "auth", "apikey", "credential",
    "contraseña", "clave", "clé", "schlüssel", "account", "iban", "ssn", "passport", "konto", "cuenta", "compte", "card", "id",
)
_CONTEXT = re.compile(r"(?i)(?<![^\W_])(?:" + "|".join(CONTEXT_WORDS) + r")\W{0,6}$")
#: Leading digits of card issuers.
_ISSUER = re.compile(r"(?:4|5[1-5]|2[2-7]|3[47]|6011|65)")


def _bytes(chars: str, *ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


_DIGITS, _UPPER, _LOWER = (48, 57), (65, 90), (97, 122)
#: Bytes of a run, bytes one of which it must hold, and the least length.
_RUNS = {
    "email": (_bytes("._%+-@", _DIGITS, _UPPER, _LOWER), _bytes("@"), 5),
    "ip": (_bytes(".", _DIGITS), _bytes("."), 7),
    "card": (_bytes(" -", _DIGITS), _bytes("", _DIGITS), 13),
    "phone": (_bytes("+ ().-", _DIGITS), _bytes("+"), 10),
    "number": (_bytes("", _DIGITS), _bytes("", _DIGITS), 9),
    "code": (_bytes("_-+/=", _DIGITS, _UPPER, _LOWER), _bytes("", _DIGITS), 20),
}


_WORD = _bytes("_", _DIGITS, _UPPER, _LOWER, (128, 255))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in found.split("."))
    if kind in ("card", "phone"):
        digits = re.sub(r"[^0-9]", "", found)
        return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15
    return True


def runs(part: Slice, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte borders of the runs in which a pattern can match."""
    allowed, trigger, least = _RUNS[name]
    data, n = part.data, len(part.data)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = allowed[data]
    left, right = inside.copy(), inside.copy()
    left[1:] &= ~inside[:-1]
    right[:-1] &= ~inside[1:]
    first = part.offsets[:-1][part.offsets[:-1] < n]
    left[first] = inside[first]
    last = part.offsets[1:][part.offsets[1:] > 0] - 1
    right[last] = inside[last]
    starts, ends = np.flatnonzero(left), np.flatnonzero(right) + 1
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if len(starts):
        marks = np.flatnonzero(trigger[data])
        has = np.searchsorted(marks, ends) > np.searchsorted(marks, starts)
        starts, ends = starts[has], ends[has]
    return starts, ends


Span = tuple[int, int, str]


def base_spans(part: Slice) -> dict[int, dict[str, list[tuple[int, int]]]]:
    """Text index -> kind -> byte spans within the slice, in order."""
    out: dict[int, dict[str, list[tuple[int, int]]]] = {}
    for kind, pattern in _COMPILED.items():
        starts, ends = runs(part, kind)
        docs = np.searchsorted(part.offsets, starts, side="right") - 1
        for a, b, doc in zip(starts.tolist(), ends.tolist(), docs.tolist(), strict=True):
            for m in pattern.finditer(part.data[a:b].tobytes().decode("ascii")):
                if valid(kind, m.group()):
                    out.setdefault(doc, {}).setdefault(kind, []).append((a + m.start(), a + m.end()))
    return out


# ------------------------------------------------------------ weak supervision
#: Features of a candidate, each a small integer; votes are -1 (no opinion), 0, 1.
N_VOTES = 4
FEATURES = ("kind", "length", "entropy", "letters", "context", "quoted", "checksum")


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def candidate(text: str, before: str, after: str) -> tuple[str, tuple[int, ...], tuple[int, ...]]:
    """Kind, votes of the labelers and features of one candidate."""
    digits = sum(c.isdigit() for c in text)
    number = digits == len(text)
    bits = _entropy(text)
    shape = int(bool(re.fullmatch(r"[0-9a-fA-F]{32,128}|[A-Za-z0-9+/=_-]{24,}", text)) and digits >= 4) if not number else int(len(text) in (9, 11, *range(13, 20)))
    checksum = int(luhn(text)) if number and len(text) <= 19 else -1
    context = int(bool(_CONTEXT.search(before)))
    gazetteer = (1 if _ISSUER.match(text) and 13 <= len(text) <= 19 else 0) if number else (1 if context else -1)
    spread = int(bits >= 3.0) if not number else -1
    votes = (shape, checksum if number else spread, gazetteer, context if context else (0 if number else -1))
    quoted = int(before[-1:] in "\"'`=:" and bool(before[-1:]) or after[:1] in "\"'`" and bool(after[:1]))
    features = (int(number), min(7, len(text) // 8), min(5, int(bits)), min(4, int(5 * (1 - digits / len(text)))), context, quoted, checksum + 1)
    return ("number" if number else "secret"), votes, features


def candidates(part: Slice, base: dict[int, dict[str, list[tuple[int, int]]]]):
    """(text index, byte start, byte end, kind, votes, features) outside base spans."""
    starts, ends = runs(part, "code")
    found = [(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    a, b = runs(part, "number")
    # digits inside a word or a longer code are no number of their own
    data = np.r_[np.uint8(32), part.data, np.uint8(32)]
    lone = ~((_WORD[data[a]] & ~np.isin(a, part.offsets)) | (_WORD[data[b + 1]] & ~np.isin(b, part.offsets)))
    found += zip(a[lone].tolist(), b[lone].tolist(), strict=True)
    for x, y in sorted(set(found)):
        doc = int(np.searchsorted(part.offsets, x, side="right")) - 1
        if any(s < y and x < e for spans in base.get(doc, {}).values() for s, e in spans):
            continue
        text = part.data[x:y].tobytes().decode("ascii")
        if sum(c.isdigit() for c in text) < 4:
            continue
        lo, hi = int(part.offsets[doc]), int(part.offsets[doc + 1])
        before = part.data[max(lo, x - 24) : x].tobytes().decode("utf-8", "ignore")
        after = part.data[y : min(hi, y + 2)].tobytes().decode("utf-8", "ignore")
        yield doc, x, y, *candidate(text, before, after)


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 50, prior: float = 0.5) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """P(personal) of each vote pattern, and P(vote 1 | class) of each labeler.

    Labelers are taken as independent given the class; they start as better
    than chance, which fixes the meaning of the classes.
    """
    if not patterns:
        return {}, np.full((N_VOTES, 2), 0.5)
    votes = np.array([p for p, _ in patterns])
    weight = np.array([w for _, w in patterns], dtype=float)
    yes = np.tile([0.3, 0.8], (votes.shape[1], 1))
    share = prior
    for _ in range(rounds):
        like = np.ones((len(votes), 2)) * [1 - share, share]
        for j in range(votes.shape[1]):
            v = votes[:, j]
            like *= np.where(v[:, None] == 1, yes[j], np.where(v[:, None] == 0, 1 - yes[j], 1.0))
        p = like / like.sum(1, keepdims=True)
        share = float(np.clip((weight * p[:, 1]).sum() / weight.sum(), 0.02, 0.98))
        for j in range(votes.shape[1]):
            said = votes[:, j] >= 0
            for c in (0, 1):
                own = weight[said] * p[said, c]
                yes[j, c] = (own[votes[said, j] == 1].sum() + 1) / (own.sum() + 2)
    return {tuple(v): float(x) for v, x in zip(votes.tolist(), p[:, 1], strict=True)}, yes


class SpanClassifier:
    """Logistic weights over one-hot features."""

    WIDTH = 8

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @classmethod
    def columns(cls, features: np.ndarray) -> np.ndarray:
        return features + np.arange(features.shape[1]) * cls.WIDTH

    @classmethod
    def fit(cls, rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 300, rate: float = 0.5) -> SpanClassifier:
        """rows: features, probability, weight."""
        w = np.zeros(len(FEATURES) * cls.WIDTH + 1)
        if not rows:
            w[-1] = -10.0
            return cls(w)
        at = cls.columns(np.array([r[0] for r in rows]))
        y, weight = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], dtype=float)
        weight = weight / weight.sum()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(w[at].sum(1) + w[-1])))
            error = (y - p) * weight
            step = np.zeros_like(w)
            np.add.at(step, at, error[:, None])
            step[-1] = error.sum()
            w += rate * (step - 1e-4 * w)
        return cls(w)

    def accept(self, features: tuple[int, ...]) -> bool:
        at = self.columns(np.array([features]))[0]
        return float(self.weights[at].sum() + self.weights[-1]) > 0


def _count(batches):
    """Votes and features of all candidates, counted over a batch."""
    for batch in batches:
        counts: Counter = Counter()
        for part in slices(batch.column(0)):
            for _, _, _, _, votes, features in candidates(part, base_spans(part)):
                counts[",".join(map(str, votes)), ",".join(map(str, features))] += 1
        yield pa.RecordBatch.from_pydict({"votes": pa.array([k[0] for k in counts], pa.string()), "features": pa.array([k[1] for k in counts], pa.string()), "n": pa.array(counts.values(), pa.int64())})


def learn(docs: DataFrame) -> SpanClassifier:
    """Label model and classifier from the counts over all documents.

    The counts have at most 3**4 vote patterns times the values of the features:
    a bound that does not depend on the input.
    """
    counts = id_text(docs).select("text").mapInArrow(tidy(_count), "votes string, features string, n long").groupBy("votes", "features").agg(F.sum("n").alias("n"))
    rows = [(tuple(map(int, r["votes"].split(","))), tuple(map(int, r["features"].split(","))), r["n"]) for r in counts.collect()]
    rows.sort()
    examples = []
    for number in (0, 1):  # codes and numbers have different labelers
        own = [r for r in rows if r[1][0] == number]
        by_votes: Counter = Counter()
        for votes, _, n in own:
            by_votes[votes] += n
        chance, _ = expectation_maximisation(sorted(by_votes.items()))
        examples += [(features, chance[votes], n) for votes, features, n in own]
    return SpanClassifier.fit(examples)


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def _spans(model: SpanClassifier):
    order = {k: i for i, k in enumerate((*KINDS, "number", "secret"))}

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for part in slices(batch.column(1)):
                base = base_spans(part)
                extra: dict[int, list[Span]] = {}
                for doc, a, b, kind, _, features in candidates(part, base):
                    if model.accept(features):
                        extra.setdefault(doc, []).append((a, b, kind))
                counts, base_text, all_text = [], [], []
                for doc in range(len(part)):
                    if doc not in base and doc not in extra:
                        counts.append((0, 0, 0, 0))
                        base_text.append("")
                        all_text.append("")
                        continue
                    lo, hi = int(part.offsets[doc]), int(part.offsets[doc + 1])
                    place = np.r_[0, np.cumsum((part.data[lo:hi] & 0xC0) != 0x80)]
                    say = lambda spans: ",".join(f"{k}:{place[a - lo]}:{place[b - lo]}" for a, b, k in sorted(spans, key=lambda s: (order[s[2]], s[0])))  # noqa: B023, E731
                    own = [(a, b, k) for k, spans in base.get(doc, {}).items() for a, b in spans]
                    counts.append(tuple(len(base.get(doc, {}).get(k, ())) for k in KINDS))
                    base_text.append(say(own))
                    all_text.append(say(own + extra.get(doc, [])))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(part.first, len(part)), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(base_text, pa.string()), pa.array(all_text, pa.string())],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"],
                )

    return run


def find_pii(docs: DataFrame, model: SpanClassifier | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, base spans and all spans of every text."""
    model = model or learn(docs)
    return id_text(docs).mapInArrow(tidy(_spans(model)), OUT)


def pii_digests(docs: DataFrame) -> DataFrame:
    return find_pii(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def redact(text: str, spans: str) -> str:
    """``text`` with every span replaced by its kind in angle brackets."""
    found = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for a, b, kind in found:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = b
    return "".join(out) + text[at:]
