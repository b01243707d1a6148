"""Chat formatting: recover speakers of raw transcripts by a hidden Markov model.

A transcript is a sequence of pieces (conv_id, part, text).  Every line is one
observation: the speaker marker it starts with, if any, whether a piece or a
blank line ends before it, whether it is the first, and features of the line
(length, question mark).  States are the roles.  Markers and transitions have
fixed log scores; line features are counted from labelled turns.  Viterbi gives
the roles; runs of one role become turns in the canonical form.

A conversation may hold a third of all rows, so it is never decoded in one task:
blocks of at most ``BLOCK`` rows give (max, +) matrices from the role before a block
to the role at its end, two streaming passes over these small matrices fix the role
at every border, and all blocks are then decoded independently.  The result is
that of one Viterbi over the whole conversation.

A turn may run over many pieces and blocks.  Its head is written by the piece that
opens it and its end by the piece that closes it, so the rows of a conversation, one
below the other, are its canonical form, whatever the length of a turn.

Null texts are empty lines.  Null parts come first, as many as there are; ties are
in an order fixed by a hash of the text.  Rows without conv_id form one conversation.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import saved

ROLES = ("system", "user", "assistant")
BLOCK = 64
# Names that speaker markers use for each role.
NAMES = {
    "system": ("system", "instructions", "instruction", "context"),
    "user": ("user", "human", "question", "q", "customer", "me", "prompter"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "model", "agent", "gpt"),
}
_ROLE_OF = {name: i for i, role in enumerate(ROLES) for name in NAMES[role]}
_MARKER = re.compile(r"\s*(?:>\s*|#{1,4}\s*|\*\*)?(?:\[([A-Za-z]+)\]|<\|([A-Za-z]+)\|>|([A-Za-z]+)(?:\*\*)?\s*:(?:\*\*)?|(?<=#\s)([A-Za-z]+)\s*$|(?<=##)([A-Za-z]+)\s*$)\s*")

#: Log score of a marker seen with its own role, and with another.
MARK_OWN, MARK_OTHER = np.log(0.97), np.log(0.015)
#: Transitions inside a piece, and across the end of a piece, a blank line or a marker.
INSIDE = np.log(np.array([[0.98, 0.01, 0.01], [0.002, 0.988, 0.01], [0.002, 0.01, 0.988]]))
ACROSS = np.log(np.array([[0.20, 0.70, 0.10], [0.02, 0.18, 0.80], [0.02, 0.78, 0.20]]))
START = np.log(np.array([0.2, 0.7, 0.1]))
LENGTHS = (40, 90, 160, 260, 400)
N_FEATURES = 2 * (len(LENGTHS) + 1)


def marker(line: str) -> tuple[int, str]:
    """Role index of the marker that a line starts with (-1: none), and the rest."""
    m = _MARKER.match(line)
    if m:
        name = next(g for g in m.groups() if g).lower()
        if name in _ROLE_OF:
            return _ROLE_OF[name], line[m.end() :]
    return -1, line


def feature(line: str) -> int:
    return 2 * sum(len(line) >= x for x in LENGTHS) + ("?" in line)


def observe(text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Lines without markers; marker role, feature, and border flag of each."""
    lines, marks, feats, borders = [], [], [], []
    border = True
    for raw in (text or "").split("\n"):
        role, rest = marker(raw)
        lines.append(rest)
        marks.append(role)
        feats.append(feature(rest))
        borders.append(border or role >= 0)
        border = not raw.strip()
    return lines, np.array(marks), np.array(feats), np.array(borders)


def emissions(marks: np.ndarray, feats: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = table[feats].copy()
    for r in range(len(ROLES)):
        own = marks == r
        out[own] += MARK_OTHER
        out[own, r] += MARK_OWN - MARK_OTHER
    return out


def block_matrix(emit: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Best score from the role before the block (row) to the role at its end."""
    best = np.where(np.eye(3, dtype=bool), 0.0, -np.inf)
    for e, b in zip(emit, border, strict=True):
        best = (best[:, :, None] + (ACROSS if b else INSIDE)[None, :, :]).max(1) + e[None, :]
    return best


def decode(emit: np.ndarray, border: np.ndarray, before: int, end: int, first: int = -1) -> np.ndarray:
    """Viterbi path of a block; before is -1 at the start of a conversation, first the role it starts with if known."""
    score = START + emit[0] if before < 0 else (ACROSS if border[0] else INSIDE)[before] + emit[0]
    if first >= 0:
        score = np.where(np.arange(len(ROLES)) == first, score, -np.inf)
    back = []
    for e, b in zip(emit[1:], border[1:], strict=True):
        step = score[:, None] + (ACROSS if b else INSIDE)
        back.append(step.argmax(0))
        score = step.max(0) + e
    path = [end if end >= 0 else int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def feature_table(turns: DataFrame | None) -> np.ndarray:
    """Log probability of each line feature for each role, from labelled turns.

    ``turns`` has columns role and text; counts have ``N_FEATURES`` rows a role at most.
    """
    counts = np.ones((N_FEATURES, len(ROLES)))
    if turns is not None:
        line = F.col("line")
        kind = sum((F.when(F.length(line) >= x, 2).otherwise(0) for x in LENGTHS), F.lit(0)) + F.when(F.instr(line, "?") > 0, 1).otherwise(0)
        lines = turns.select(F.lower("role").alias("role"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
        for r in lines.filter(F.col("role").isin(*ROLES)).groupBy("role", kind.alias("kind")).count().collect():
            counts[r["kind"], ROLES.index(r["role"])] += r["count"]
    return np.log(counts / counts.sum(0))


def _groups(batches: Iterator[pa.RecordBatch]):
    """Rows of each (conv_id, block) in a row: partitions are sorted."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["conv_id"], row["block"])
            if own != key and held:
                yield key, held
                held = []
            key = own
            held.append(row)
    if held:
        yield key, held


def _observed(rows: list[dict], table: np.ndarray):
    seen = [observe(r["text"]) for r in rows]
    border = np.concatenate([s[3] for s in seen])
    return seen, np.concatenate([emissions(s[1], s[2], table) for s in seen]), border


_MATRIX = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("opening", pa.list_(pa.float64())), ("matrix", pa.list_(pa.float64())), ("starts", pa.list_(pa.int64())), ("marked", pa.bool_())])
_MATRIX_COLUMNS = "conv_id long, block long, opening array<double>, matrix array<double>, starts array<long>, marked boolean"


def _matrices(table: np.ndarray):
    def run(batches):
        for (conv, block), rows in _groups(batches):
            seen, emit, border = _observed(rows, table)
            first = (START + emit[0]).tolist()
            rest = block_matrix(emit[1:], border[1:]) if len(emit) > 1 else np.where(np.eye(3, dtype=bool), 0.0, -np.inf)
            opening = (np.array(first)[:, None] + rest).max(0)
            # role before the block (row) and at its end: by way of which first role
            ways = ((ACROSS if border[0] else INSIDE) + emit[0])[:, :, None] + rest[None, :, :]
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "block": block, "opening": opening.tolist(), "matrix": ways.max(1).ravel().tolist(), "starts": ways.argmax(1).ravel().tolist(), "marked": bool(seen[0][1][0] >= 0)}], schema=_MATRIX)

    return run


_NONE = object()


def _forward(batches):
    """Scores of the roles before each block, streaming in block order."""
    conv, score = _NONE, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["conv_id"] != conv:
                conv, score = row["conv_id"], None
            matrix = np.array(row["matrix"]).reshape(3, 3)
            out.append(row | {"before": None if score is None else score.tolist()})
            score = np.array(row["opening"]) if score is None else (score[:, None] + matrix).max(0)
            score = score - score.max()
        yield pa.RecordBatch.from_pylist(out, schema=_MATRIX.append(pa.field("before", pa.list_(pa.float64()))))


def _backward(batches):
    """Roles at the borders of each block and whether its last turn ends there, streaming from the last block."""
    conv, end, closes = _NONE, -1, True
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            matrix = np.array(row["matrix"]).reshape(3, 3)
            if row["conv_id"] != conv:
                conv = row["conv_id"]
                last = np.array(row["opening"]) if row["before"] is None else (np.array(row["before"])[:, None] + matrix).max(0)
                end, closes = int(last.argmax()), True
            entry = -1 if row["before"] is None else int((np.array(row["before"]) + matrix[:, end]).argmax())
            first = -1 if entry < 0 else row["starts"][3 * entry + end]
            out.append({"conv_id": row["conv_id"], "block": row["block"], "entry": entry, "end": end, "first": first, "closes": closes})
            # the block before ends its last turn if this one opens a turn
            end, closes = entry, first != entry or row["marked"]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()), ("end", pa.int32()), ("first", pa.int32()), ("closes", pa.bool_())]))


def render(role: str, text: str, opens: bool = True, closes: bool = True) -> str:
    return (f"<|{role}|>\n" if opens else "") + text.strip() + ("\n<|end|>" if closes else "")


_TURNS = "conv_id long, part long, place long, turn long, recovered string, opens boolean, closes boolean, n_lines long, rendered string"
_TURN = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("recovered", pa.string()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("n_lines", pa.int64()), ("rendered", pa.string())])


def _decoded(table: np.ndarray):
    def run(batches):
        for (conv, _), rows in _groups(batches):
            seen, emit, border = _observed(rows, table)
            path = decode(emit, border, rows[0]["entry"], rows[0]["end"], rows[0]["first"])
            last, at, out = rows[0]["entry"], 0, []
            for row, (lines, marks, _, _) in zip(rows, seen, strict=True):
                own = path[at : at + len(lines)]
                at += len(lines)
                cuts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1] or marks[i] >= 0), len(own)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    role = int(own[a])
                    out.append({"conv_id": conv, "part": row["part"], "place": row["place"], "turn": k, "recovered": ROLES[role], "opens": bool(role != last or marks[a] >= 0), "n_lines": b - a, "text": "\n".join(lines[a:b])})
                    last = role
            for this, closes in zip(out, [*(x["opens"] for x in out[1:]), rows[0]["closes"]], strict=True):
                this["closes"] = closes
                this["rendered"] = render(this["recovered"], this.pop("text"), this["opens"], closes)
            yield pa.RecordBatch.from_pylist(out, schema=_TURN)

    return run


def parse_transcripts(pieces: DataFrame, table: np.ndarray | None = None) -> DataFrame:
    """Turns of each piece: conv_id, part, place, turn, recovered role, opens, closes, n_lines, rendered.

    ``opens`` is false where a piece goes on with the turn before it, ``closes`` where the
    turn goes on in the next piece; ``place`` and ``turn`` give the order of the rows.
    """
    table = feature_table(None) if table is None else table
    own = pieces.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("part").cast("long").alias("part"), F.col("text").cast("string").alias("text"))
    # rows in order over range partitions, so that neither a conversation nor parts that are null or tie meet in one task
    own = own.withColumn("_tie", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    order = ["conv_id", "part", "_tie", "_row"]
    own = own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    own = saved(own.select("conv_id", "part", "text", "place", F.shiftright("place", BLOCK.bit_length() - 1).alias("block")), "transcript-pieces")
    dealt = own.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place")
    matrices = dealt.mapInArrow(_matrices(table), _MATRIX_COLUMNS)
    forward = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_forward, f"{_MATRIX_COLUMNS}, before array<double>")
    ends = forward.sortWithinPartitions("conv_id", F.col("block").desc()).mapInArrow(_backward, "conv_id long, block long, entry int, end int, first int, closes boolean")
    ends = saved(ends.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "entry", "end", "first", "closes"), "transcript-borders")
    known = own.join(ends, own["conv_id"].eqNullSafe(F.col("c")) & (own["block"] == F.col("b"))).select("conv_id", "block", "part", "text", "place", "entry", "end", "first", "closes")
    return known.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place").mapInArrow(_decoded(table), _TURNS)


# How raw transcripts mark their speakers, one style a conversation.
_STYLES = (
    ("System: ", "User: ", "Assistant: "), ("### System:\n", "### Human:\n", "### Assistant:\n"),
    ("[system] ", "[user] ", "[assistant] "), ("Context: ", "Q: ", "A: "),
)


def raw_transcripts(conversations: DataFrame, unmarked: int = 4) -> DataFrame:
    """Conversations as raw pieces, with one marker in ``unmarked`` left out.

    conv_id, part (the turn), text with its marker, and the true role.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(_STYLES)))
    mark = F.lit("")
    for i, names in enumerate(_STYLES):
        for role, name in zip(ROLES, names, strict=True):
            mark = F.when((style == i) & (F.lower("role") == role), F.lit(name)).otherwise(mark)
    hidden = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(unmarked)) == 0
    return conversations.select("conv_id", F.col("turn").alias("part"), F.lower("role").alias("role"), F.concat(F.when(hidden, F.lit("")).otherwise(mark), F.coalesce("text", F.lit(""))).alias("text"))


def chat_turns(conversations: DataFrame) -> DataFrame:
    """Strip the roles of conversations, recover them, and render canonical turns."""
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").cast("string").alias("text"))
    table = feature_table(own.filter(F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 != 2, F.lit(False))))
    return parse_transcripts(raw_transcripts(own).drop("role"), table).drop("place")
