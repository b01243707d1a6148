"""Token ids in binary blocks: encode, order by document, write, read back.

Files are Parquet tables of blocks in the store that Spark writes to, so they
need no local folder and a lost executor repeats one shard.  A block holds whole
documents in ascending doc_id order: their ids, token counts, the first
Simple-8b word of each, the words, the escapes, and ``first``, the ids that come
before it in its shard.  Shards are ranges of doc_id.

Null texts are empty and get the end id alone.  Null doc_ids sort first; repeated
doc_ids are ordered by their token count and words.  An empty table writes no block.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import simple8b
from quantloom.llm.common import id_text, saved, tidy
from quantloom.llm.textkernel import SPACE, Slice, lowered, slices, words

END_ID = 1
BLOCK_IDS = 1 << 16
CACHE_WORDS = 650_000
#: Texts encoded together; the more, the fewer lookups of words that repeat.
ENCODE_BYTES = 6 << 20


def _pieces(part: Slice) -> tuple[pa.Array, np.ndarray]:
    """Strings that the tokenizer's own splitting never joins, and the text of each.

    A white-space separated word of ASCII and Latin-1 letters is cut into runs of
    letters, single digits and runs of other characters, and lower-cased, as the
    tokenizer does itself.  Words with an apostrophe or ``<`` (contractions, special
    tokens) or with any other character stay whole and as they are.
    """
    data = part.data
    found = words(part)
    if not len(found.starts):
        return pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
    kind = _KINDS[data]
    pair = np.flatnonzero(data == 0xC3)
    pair = pair[pair + 1 < len(data)]
    follow = data[pair + 1]
    pair = pair[(follow >= 0x80) & (follow <= 0xBF) & (follow != 0x97) & (follow != 0xB7)]
    kind[pair] = kind[pair + 1] = 1
    # _KINDS: 0 space, 1 letter, 2 digit, 3 other, 4 keeps its word whole
    odd = np.flatnonzero(kind == 4)
    low = lowered(data)
    upper = pair[(data[pair + 1] <= 0x9E)]
    low[upper + 1] += 0x20
    if len(odd):
        whole = np.unique(np.searchsorted(found.starts, odd, side="right") - 1)
        size = found.ends[whole] - found.starts[whole]
        at = np.repeat(found.starts[whole] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
        kind[at] = 4
        low[at] = data[at]
    opens = np.empty(len(data), dtype=bool)
    opens[0] = True
    opens[1:] = kind[1:] != kind[:-1]
    opens |= kind == 2
    opens &= kind != 0
    opens[found.starts] = True
    solid = kind != 0
    where = np.flatnonzero(opens)
    before = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(solid, out=before[1:])
    offsets = np.r_[before[where], before[-1]].astype(np.int32)
    made = pa.StringArray.from_buffers(len(where), pa.py_buffer(offsets), pa.py_buffer(low[solid]))
    return made, np.searchsorted(part.offsets, where, side="right") - 1


_KINDS = np.full(256, 3, dtype=np.uint8)
_KINDS[SPACE] = 0
_KINDS[65:91] = _KINDS[97:123] = 1
_KINDS[48:58] = 2
_KINDS[128:] = 4
_KINDS[[ord("'"), ord("<")]] = 4


class WordCache:
    """Token ids of pieces, kept for the life of a worker.

    The tokenizer drops white space before anything else and never joins two
    pieces, so the ids of a text are those of its pieces in a row.
    """

    TOGETHER = 4000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.most = CACHE_WORDS
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        # code 0 is the end of a text
        self.code: dict[str | None, int] = {None: 0}
        self.starts = np.array([0, 1], dtype=np.int64)
        self.flat = np.array([END_ID], dtype=np.uint32)
        self.lists: pa.LargeListArray | None = None

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.code)
        self.code.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, ids])

    def _alone(self, pieces: list[str]) -> None:
        made = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
        self._add(pieces, np.fromiter((x for ids in made for x in ids), dtype=np.uint32, count=int(sizes.sum())), sizes)

    def codes(self, pieces: list[str]) -> np.ndarray:
        if len(self.code) + len(pieces) > self.most:
            self.clear()
        found = list(map(self.code.get, pieces))
        fresh = [p for p, c in zip(pieces, found, strict=True) if c is None]
        if not fresh:
            return np.array(found, dtype=np.int64)
        # plain words go in together: each closes with its one end-of-word token
        plain = [p for p in fresh if p.isalpha() and (p.isascii() or p < "\u0100" and max(p) < "\u0100")]
        for i in range(0, len(plain), self.TOGETHER):
            some = plain[i : i + self.TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):
                self._add(some, ids, np.diff(np.r_[0, ends]))
            else:
                self._alone(some)
        if rest := [p for p in fresh if p not in self.code]:
            self._alone(rest)
        return np.fromiter(map(self.code.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each closed by the end id; ids of each text."""
        pieces, doc = _pieces(part)
        if len(pieces):
            pieces = pieces.dictionary_encode()
            code = self.codes(pieces.dictionary.to_pylist())[pieces.indices.to_numpy(zero_copy_only=False)]
        else:
            code = np.zeros(0, dtype=np.int64)
        piece_end = np.cumsum(np.bincount(doc, minlength=len(part)))
        code = np.insert(code, piece_end, 0)
        if self.lists is None or len(self.lists) != len(self.starts) - 1:
            self.lists = pa.LargeListArray.from_arrays(pa.array(self.starts), pa.array(self.flat))
        taken = self.lists.take(pa.array(code))
        before = taken.offsets.to_numpy()
        own = np.diff(before[np.r_[0, piece_end + np.arange(1, len(part) + 1)]])
        return taken.values.to_numpy(), own


_CACHES: dict[str, WordCache] = {}


def _cache(path: str) -> WordCache:
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


ENCODED = "shard int, doc_id long, n long, words binary, escapes binary"


def _encode(path: str, bounds: np.ndarray, cache_words: int, encode_bytes: int):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = _cache(path)
        cache.most = cache_words
        for batch in batches:
            ids = batch.column(0)
            for part in slices(batch.column(1), encode_bytes):
                tokens, counts = cache.encode(part)
                words, first, escapes = simple8b.encode(tokens, counts)
                which = np.r_[0, np.cumsum(np.bincount(np.searchsorted(first, np.flatnonzero((words >> np.uint64(60)) == 0), side="right") - 1, minlength=len(counts)))] if len(escapes) else np.zeros(len(counts) + 1, dtype=np.int64)
                packed = []
                for i in range(len(counts)):
                    mine = words[first[i] : first[i + 1]]
                    if len(escapes):  # escape places count from the document's own first
                        mine = np.where((mine >> np.uint64(60)) == 0, mine - np.uint64(which[i]), mine)
                    packed.append(mine.astype("<u8").tobytes())
                own = ids.slice(part.first, len(part))
                known = own.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.searchsorted(bounds, known), pa.int32()), own, pa.array(counts, pa.int64()),
                    pa.array(packed, pa.binary()), pa.array([escapes[which[i] : which[i + 1]].astype("<u8").tobytes() for i in range(len(counts))], pa.binary()),
                ], names=["shard", "doc_id", "n", "words", "escapes"])

    return run


BLOCKS = "shard int, block long, first long, n_ids long, doc_ids array<long>, counts array<long>, word_offsets array<long>, escape_offsets array<long>, words binary, escapes binary"


_BLOCK_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("word_offsets", pa.list_(pa.int64())), ("escape_offsets", pa.list_(pa.int64())), ("words", pa.binary()), ("escapes", pa.binary())])


def _block(batches):
    """Group the sorted documents of each shard into blocks."""
    shard, block, before = -1, 0, 0
    held: list[tuple] = []
    size = 0

    def close():
        nonlocal block, before, held, size
        ids, counts, words, escapes = zip(*held, strict=True)
        offsets = lambda parts: np.r_[0, np.cumsum([len(p) // 8 for p in parts])].tolist()
        row = pa.RecordBatch.from_pylist([{
            "shard": shard, "block": block, "first": before, "n_ids": size, "doc_ids": list(ids), "counts": list(counts),
            "word_offsets": offsets(words), "escape_offsets": offsets(escapes), "words": b"".join(words), "escapes": b"".join(escapes),
        }], schema=_BLOCK_SCHEMA)
        block, before, held, size = block + 1, before + size, [], 0
        return row

    for batch in batches:
        for own, *row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if own != shard:
                if held:
                    yield close()
                shard, block, before = own, 0, 0
            held.append(row)
            size += row[1]
            if size >= BLOCK_IDS:
                yield close()
    if held:
        yield close()


def shard_bounds(docs: DataFrame, shards: int) -> np.ndarray:
    """Ascending doc_ids that split the documents into ranges of about equal count.

    From a quantile sketch over the id column alone, so no text is read or encoded
    twice; any bounds give right results, the sketch only balances the shards.
    """
    steps = F.array(*[F.lit(i / shards) for i in range(1, shards)]) if shards > 1 else None
    found = None if steps is None else docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), steps, F.lit(100 * shards))).first()[0]
    return np.unique(np.array(found or [], dtype=np.int64))


def write_blocks(docs: DataFrame, tokenizer: str, shards: int | None = None, cache_words: int = CACHE_WORDS, encode_bytes: int = ENCODE_BYTES, batch_rows: int | None = None) -> DataFrame:
    """Encode and write all documents; the written table of blocks.

    ``cache_words``, ``encode_bytes`` and ``batch_rows`` (rows that reach a worker at once;
    the session's setting where it is not given) trade a worker's memory for speed.
    """
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded = id_text(docs).mapInArrow(tidy(_encode(tokenizer, shard_bounds(docs, shards), cache_words, encode_bytes)), ENCODED)
    ordered = encoded.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "n", "words")
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    try:
        conf.set(name, str(batch_rows or before))
        return saved(ordered.mapInArrow(tidy(_block), BLOCKS), "token-blocks")
    finally:
        conf.set(name, before)


def decode_block(row: dict) -> np.ndarray:
    """All ids of one block, as unsigned 32-bit integers where they fit."""
    words = np.frombuffer(row["words"], dtype="<u8")
    first, counts = np.array(row["word_offsets"], dtype=np.int64), np.array(row["counts"], dtype=np.int64)
    escapes = np.frombuffer(row["escapes"], dtype="<u8")
    if len(escapes):
        at = np.flatnonzero((words >> np.uint64(60)) == 0)
        doc = np.searchsorted(first, at, side="right") - 1
        words = words.copy()
        words[at] += np.array(row["escape_offsets"], dtype=np.uint64)[doc]
    return simple8b.decode(words, first, counts, escapes)


def _digest(batches):
    for batch in batches:
        for row in batch.to_pylist():
            raw = decode_block(row).astype("<u4").tobytes()
            counts = np.array(row["counts"], dtype=np.int64)
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array([row["shard"]] * len(counts), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                pa.array([zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)], pa.int64()),
            ], names=["shard", "doc_id", "local", "n_tokens", "ids_crc32"])


def read_digests(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    # one row for each shard: as many as the writer had partitions
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = totals.select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = blocks.mapInArrow(tidy(_digest), "shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, cache_words: int = CACHE_WORDS, encode_bytes: int = ENCODE_BYTES, batch_rows: int | None = None) -> DataFrame:
    return read_digests(write_blocks(docs, tokenizer, None, cache_words, encode_bytes, batch_rows))
