"""Line dedup that can be undone: sharded cuckoo filters over exact reference counts.

The state is a table ``(shard, hi, lo, refs)``: for each line key the number of
documents that contain it.  Inserting documents adds their keys, deleting them
subtracts, so any batch can be taken back.  From the table each shard builds a
cuckoo filter of its frequent keys (16-bit fingerprints, four slots a bucket),
which supports insert and delete too.  Filter hits among infrequent keys are
found once in the exact table; they are the shard's exceptions, so
``hit and not an exception`` is exactly ``refs >= min_docs``.

Nothing of this is collected or broadcast: keys are dealt by shard, and a task
streams one shard after another, first its filter, then its exceptions, then the
keys to test.  There are as many shards as keep a filter small, and a shard that
many lines fall on (a line that a third of all documents have) is dealt over
several tasks, each with a copy of its filter.

Null and empty texts are one empty line.  A document counts once for a key,
however often it has the line; repeated rows of one doc_id count as documents of
their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import discard, id_text, maybe_broadcast, saved, tidy
from quantloom.llm.textkernel import slices

MIN_DOCS = 10
#: Frequent keys in a filter, and keys that one task tests against it.
SHARD_KEYS = 250_000
TASK_KEYS = 2_000_000
_STRIP = b" \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# ---------------------------------------------------------------- cuckoo filter
class CuckooFilter:
    """Fingerprints of 64-bit hashes, partial-key cuckoo hashing, four slots a bucket."""

    SLOTS, KICKS = 4, 500

    def __init__(self, expected: int):
        buckets = 1
        while buckets * self.SLOTS * 0.85 < max(1, expected):
            buckets *= 2
        self.table = np.zeros((buckets, self.SLOTS), dtype=np.uint16)

    @property
    def mask(self) -> np.uint64:
        return np.uint64(len(self.table) - 1)

    def _split(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes = np.asarray(hashes).astype(np.int64).view(np.uint64)
        print_ = (hashes >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        first = hashes & self.mask
        return print_, first.astype(np.int64), self._other(first, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        turn = (print_.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995)) >> np.uint64(17)
        return ((np.asarray(bucket).astype(np.uint64) ^ turn) & self.mask).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        print_, one, two = self._split(hashes)
        print_ = print_[:, None]
        return (self.table[one] == print_).any(1) | (self.table[two] == print_).any(1)

    def insert(self, hashes: np.ndarray) -> None:
        """Insert distinct hashes; OverflowError when evictions don't settle (``of`` then takes a larger table)."""
        hashes = np.asarray(hashes, dtype=np.int64)
        for print_, one, two in zip(*self._split(hashes), strict=True):
            if not self._place(print_, one, two):
                raise OverflowError(f"filter of {self.table.size} slots is full at {len(hashes)} keys")

    def _place(self, print_: np.uint16, one: int, two: int) -> bool:
        for bucket in (one, two):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return True
        bucket = two
        for kick in range(self.KICKS):
            slot = (kick + int(print_)) % self.SLOTS
            print_, self.table[bucket, slot] = self.table[bucket, slot], print_
            bucket = int(self._other(np.array([bucket]), np.array([print_], dtype=np.uint16))[0])
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return True
        return False

    def delete(self, hashes: np.ndarray) -> None:
        """Take back hashes that were inserted."""
        for print_, one, two in zip(*self._split(hashes), strict=True):
            for bucket in (one, two):
                held = np.flatnonzero(self.table[bucket] == print_)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break
            else:
                raise KeyError("hash was never inserted")

    @classmethod
    def of(cls, hashes: np.ndarray) -> CuckooFilter:
        hashes = np.unique(np.asarray(hashes, dtype=np.int64))
        room = len(hashes)
        while True:
            try:
                made = cls(room)
                made.insert(hashes)
                return made
            except OverflowError:
                room = 2 * max(room, 1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        made = cls.__new__(cls)
        made.table = np.frombuffer(data, dtype=np.uint16).reshape(-1, cls.SLOTS).copy()
        return made


# ------------------------------------------------------- reference-count tables
_KEYS = "doc_id long, print long, hi long, lo long, at array<int>"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, print, hi, lo, at): the 128-bit hash of every distinct key of a text, and its lines.

    UTF-8 bytes are stripped and lower-cased as they are: no byte of a longer character
    is a separator or a letter from A to Z.
    """
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for part in slices(batch.column(2)):
            low = part.data.tobytes().translate(_LOWER)
            offsets = part.offsets.tolist()
            row, prints, at = [], [], []
            for i in range(len(part)):
                own: dict[bytes, list[int]] = {}
                for k, line in enumerate(low[offsets[i] : offsets[i + 1]].split(b"\n")):
                    if key := line.strip(_STRIP):
                        own.setdefault(digest(key), []).append(k)
                row += [i] * len(own)
                prints += own
                at += own.values()
            hashes = np.frombuffer(b"".join(prints), dtype=">i8").astype(np.int64).reshape(-1, 2)
            take = pa.array(row, pa.int64())
            of = batch.slice(part.first, len(part))
            yield pa.RecordBatch.from_arrays([of.column(0).take(take), of.column(1).take(take), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(at, pa.list_(pa.int32()))], names=["doc_id", "print", "hi", "lo", "at"])


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, print and text; (doc_id, print) names a text, equal rows have equal names."""
    text = F.coalesce("text", F.lit(""))
    return id_text(docs).select("doc_id", F.xxhash64(text).alias("print"), text.alias("text"))


def line_keys(docs: DataFrame) -> DataFrame:
    """One row for each document and distinct key."""
    return _named(docs).mapInArrow(tidy(_keys), _KEYS)


def _counted(keys: DataFrame, shards: int) -> DataFrame:
    """The exact table of line keys; counted map-side before the shuffle."""
    return keys.groupBy("hi", "lo").agg(F.count("*").alias("refs")).select(F.pmod("hi", F.lit(shards)).cast("int").alias("shard"), "hi", "lo", "refs")


def references(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The exact table of a set of documents."""
    return _counted(line_keys(docs), shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def insert(state: DataFrame, docs: DataFrame, shards: int) -> DataFrame:
    """State after more documents."""
    return _settle(state.unionByName(references(docs, shards)))


def delete(state: DataFrame, docs: DataFrame, shards: int) -> DataFrame:
    """State after taking documents back; keys without references leave the table."""
    return _settle(state.unionByName(references(docs, shards).withColumn("refs", -F.col("refs"))))


def _settle(changes: DataFrame) -> DataFrame:
    return changes.groupBy("shard", "hi", "lo").agg(F.sum("refs").alias("refs")).filter("refs > 0")


# ------------------------------------------------------------- filters and use
def filters(frequent: DataFrame) -> DataFrame:
    """One row for each shard: the cuckoo filter of its frequent keys."""

    def build(rows):
        import pandas as pd

        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "table": [CuckooFilter.of(rows["lo"].to_numpy()).to_bytes()]})

    return frequent.select("shard", "lo").groupBy("shard").applyInPandas(build, "shard int, table binary")


#: Order of the rows of one shard in one task.
_FILTER, _EXCEPTION, _KEY = 0, 1, 2
_DEALT = "shard int, salt int, kind int, table binary, hi long, lo long, doc_id long, print long, at array<int>"


def _dealt(rows: DataFrame, kind: int) -> DataFrame:
    """Rows in the form that ``probe`` reads; columns that they lack are null."""
    made = {"shard": F.col("shard"), "salt": F.col("salt"), "kind": F.lit(kind)}
    return rows.select(*[made.get(n, F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in (c.split(" ") for c in _DEALT.split(", "))])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The key rows that the filter of their shard and task reports and that are no exception."""
    shard, made, known = None, None, np.zeros((0, 2), dtype=np.int64)
    wrong: list[np.ndarray] = []
    for batch in batches:
        of = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1).astype(np.int64)
        kind = batch.column(2).to_numpy(zero_copy_only=False)
        hashes = np.stack([batch.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k in (4, 5)], axis=1)
        keep = np.zeros(len(kind), dtype=bool)
        cuts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]).any(1) | (kind[1:] != kind[:-1])])
        for a, b in zip(cuts, [*cuts[1:], len(kind)], strict=True) if len(kind) else ():
            if shard != tuple(of[a]):
                shard, made, wrong, known = tuple(of[a]), None, [], known[:0]
            if kind[a] == _FILTER:
                made = CuckooFilter.from_bytes(batch.column(3)[int(a)].as_py())
            elif kind[a] == _EXCEPTION:
                wrong.append(hashes[a:b])
            elif made is not None:
                if wrong:
                    known, wrong = np.unique(np.concatenate([known, *wrong]), axis=0), []
                hit = made.contains(hashes[a:b, 1])
                if len(known):
                    some = np.flatnonzero(hit)
                    at = np.searchsorted(known[:, 0], hashes[a + some, 0])  # keys of one hi are told apart by lo
                    for step in range(int(np.unique(known[:, 0], return_counts=True)[1].max())):
                        place = np.minimum(at + step, len(known) - 1)
                        hit[some] &= ~(known[place] == hashes[a + some]).all(1)
                keep[a:b] = hit
        found = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([found.column(k) for k in (0, 4, 5, 6, 7, 8)], names=["shard", "hi", "lo", "doc_id", "print", "at"])


def probe(tables: DataFrame, exceptions: DataFrame | None, keys: DataFrame, shards: int) -> DataFrame:
    """The ``keys`` (shard, hi, lo and more) that their shard's filter reports and that are no exceptions.

    A shard of more than ``TASK_KEYS`` keys is dealt over several tasks.
    """
    crowded = {r["shard"]: -(-r["n"] // TASK_KEYS) for r in keys.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > TASK_KEYS).collect()}  # a row a shard
    turns = F.get(F.array(*[F.lit(crowded.get(k, 1)) for k in range(shards)]), F.col("shard")) if crowded else F.lit(1)
    copies = F.explode(F.sequence(F.lit(0), turns - 1)).alias("salt")
    salt = F.pmod(F.xxhash64("hi", "lo", *[c for c in ("doc_id", "print") if c in keys.columns]), turns).cast("int").alias("salt")
    rows = _dealt(tables.select("shard", "table", copies), _FILTER).unionAll(_dealt(keys.select("*", salt), _KEY))
    if exceptions is not None:
        rows = rows.unionAll(_dealt(exceptions.select("shard", "hi", "lo", copies), _EXCEPTION))
    ordered = rows.repartition(F.col("shard"), F.col("salt")).sortWithinPartitions("shard", "salt", "kind")
    return ordered.mapInArrow(tidy(_probe), "shard int, hi long, lo long, doc_id long, print long, at array<int>")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, state: DataFrame | None = None, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_text.

    ``state`` is a maintained reference table; without it, the table of ``docs``.
    """
    keys = saved(line_keys(docs), "line-keys")
    counted = saved(_counted(keys, 1), "line-refs") if state is None else None
    state = counted if state is None else state
    is_frequent = F.col("refs") >= min_docs
    many = state.filter(is_frequent).count()
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-many // shard_keys))
    shard = F.pmod("hi", F.lit(shards)).cast("int")
    state = state.withColumn("shard", shard)
    tables = saved(filters(state.filter(is_frequent)), "line-filters")
    wrong = saved(probe(tables, None, state.filter(~is_frequent), shards).select("shard", "hi", "lo"), "line-exceptions")
    gone = probe(tables, wrong, keys.withColumn("shard", shard), shards)
    gone = saved(gone.groupBy("doc_id", "print").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at")).select(F.col("doc_id").alias("g_id"), F.col("print").alias("g_print"), "at"), "line-gone")
    size = gone.agg(F.sum(F.size("at") * 4 + 48).alias("b")).first()["b"] or 0
    discard(keys, tables, wrong, *([] if counted is None else [counted]))
    lines = _named(docs).select("doc_id", "print", "text", F.split("text", "\n").alias("lines"))
    lines = lines.join(maybe_broadcast(gone, size, rows=False), F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("print") == F.col("g_print")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("at"))
    kept = F.when(F.col("at").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return lines.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))


def line_digests(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    return dedup_lines(docs, min_docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT rid, doc_id, i, s, translate(trim(s, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS i
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT rid) >= 10),
m AS (SELECT l.*, f.k IS NOT NULL AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
