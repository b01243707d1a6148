"""Benchmark decontamination with DataFrame operations only.

1. Windows of a text as long as an item, from a place where a shingle of such an
   item stands (a best window may start there: moving it loses nothing it shares)
   and with as many of these shingles as the threshold asks for.  Which item it
   may be is not known here, only the length.
2. Windows and items get a 128-bit SimHash of their shingles, weighted by how often
   they occur.  ``BLOCKS`` index the items' fingerprints under all block values up
   to two bits away: of any pair within ``RADIUS`` bits one of the 13 blocks differs
   in at most two (pigeonhole), so every fingerprint within the radius is found.
   The index finds the item of a window.
3. Pairs are confirmed by exact weighted-shingle similarity, sum of the smaller
   over sum of the larger counts.

At a similarity of 80 percent a bit differs with probability 0.15, so 128 bits differ
in 19.4 on average with a deviation of 4.1: the radius of 38 lies 4.6 deviations out,
while unrelated fingerprints come within it once in 300,000.

Items of fewer than five words are one shingle, their whole word sequence, and
their windows are that long.  Items without words match nothing; null texts have
no words.  Repeated rows of a doc_id count once; rows without doc_id are kept and
never reported.  Ties between windows go to the earliest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import GAP, GAP_CHARS, discard, maybe_broadcast, saved

WORDS = 5
SIMILARITY = 80
NEAR_BITS = 2
#: Blocks of the fingerprint: (half, first bit, bits).
BLOCKS = tuple((half, first, size) for half, sizes in enumerate(((9, 9, 9, 9, 9, 9, 10), (11, 11, 11, 11, 10, 10))) for first, size in zip((sum(sizes[:i]) for i in range(len(sizes))), sizes, strict=True))
RADIUS = len(BLOCKS) * (NEAR_BITS + 1) - 1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    core = F.btrim(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(GAP_CHARS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, GAP))


def shingle_array(words: str, size: int) -> Column:
    """Hashes of all runs of ``size`` words of an array column, in order."""
    return F.when(
        F.size(words) >= size,
        F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])),
    ).otherwise(F.array().cast("array<long>"))


def simhash(shingles: str) -> Column:
    """128-bit SimHash of an array column as two longs; each occurrence weighs one.

    Sum j counts bit j of all hashes in its lower half and bit j + 32 in its upper one.
    """
    one, low = F.lit(1).cast("long"), F.lit((1 << 32) - 1).cast("long")
    both = F.lit((1 << 32) + 1).cast("long")

    def right(x: Column, n: Column) -> Column:
        return F.call_function("shiftrightunsigned", x, n)

    def bits(values: Column) -> Column:
        half = F.size(values) / 2
        sums = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.aggregate(values, F.lit(0).cast("long"), lambda a, h: a + right(h, j).bitwiseAND(both)))

        def set_bits(total: Column, j: Column) -> Column:
            mark = lambda count, at: F.when(count > half, F.call_function("shiftleft", one, at)).otherwise(F.lit(0).cast("long"))
            return mark(total.bitwiseAND(low), j).bitwiseOR(mark(right(total, F.lit(32)), j + 32))

        return F.aggregate(F.transform(sums, set_bits), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    # a second hash of every shingle gives the other 64 bits
    return F.transform(F.array(F.col(shingles), F.transform(shingles, lambda h: F.xxhash64(h))), bits)


def block_value(fingerprint: Column, block: int) -> Column:
    half, first, size = BLOCKS[block]
    return F.call_function("shiftrightunsigned", fingerprint[half], F.lit(first)).bitwiseAND(F.lit((1 << size) - 1).cast("long")).cast("int")


def near_values(fingerprint: Column, block: int) -> Column:
    """All values of a block that differ from the fingerprint's in at most ``NEAR_BITS`` bits."""
    flips = F.expr(f"array({', '.join(str(x) for x in range(1 << BLOCKS[block][2]) if x.bit_count() <= NEAR_BITS)})")
    return F.transform(flips, lambda x: x.bitwiseXOR(block_value(fingerprint, block)))


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])) + F.bit_count(F.col(a)[1].bitwiseXOR(F.col(b)[1]))


def close_items(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, start, item_id) of all windows and items of one length within the radius."""
    numbers = range(len(BLOCKS))
    index = items.select("item_id", "n_words", "item_print", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), near_values(F.col("item_print"), b).alias("values")) for b in numbers])).alias("e"))
    index = index.select("item_id", "n_words", "item_print", "e.block", F.explode("e.values").alias("value"))
    probes = windows.select("doc_id", "n_words", "start", "window_print", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), block_value(F.col("window_print"), b).alias("value")) for b in numbers])).alias("e"))
    probes = probes.select("doc_id", "n_words", "start", "window_print", "e.block", "e.value")
    hits = probes.join(index, ["n_words", "block", "value"]).filter(distance("item_print", "window_print") <= RADIUS)
    return hits.select("doc_id", "n_words", "start", "item_id").distinct()


def shared_weight(a: str, b: str) -> Column:
    """Sum over common shingles of the smaller count."""
    count = lambda name, h: F.size(F.filter(name, lambda x: x == h))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    both = F.array_intersect(a, b)
    return F.when(plain, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda s, h: s + F.least(count(a, h), count(b, h))))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, its words in a window, shingle size, shingles and fingerprint."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_array(F.col("text")).alias("w")).filter(F.size("w") > 0)
    shingles = F.array().cast("array<long>")
    for k in range(WORDS, 0, -1):
        shingles = F.when((F.size("w") >= WORDS) if k == WORDS else (F.size("w") == k), shingle_array("w", k)).otherwise(shingles)
    rows = rows.select("item_id", F.size("w").alias("n_words"), F.least(F.size("w"), F.lit(WORDS)).alias("k"), shingles.alias("item"))
    return rows.select("*", simhash("item").alias("item_print")).dropDuplicates(["item_id", "item"])


def windows_of(docs: DataFrame, items: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_words, start, window) of the places that may hold an item; saved."""
    short = [r["k"] for r in items.filter(F.col("k") < WORDS).select("k").distinct().collect()]  # at most four
    kinds = [WORDS, *sorted(short)]
    # shingles by the length of the items that have them, not by item
    marks = saved(items.select("k", "n_words", F.size("item").alias("m"), F.explode(F.array_distinct("item")).alias("h")).distinct(), "bench-shingles")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")

    def each_kind(rows: DataFrame, columns) -> DataFrame:
        worded = rows.select("doc_id", word_array(F.col("text")).alias("w"))
        out = None
        for k in kinds:
            part = worded.select("doc_id", F.lit(k).alias("k"), *columns(k))
            out = part if out is None else out.unionAll(part)
        return out

    # exploded where it is made: a name for the array would be inlined into its own loop by the optimiser
    anchors = each_kind(texts, lambda k: ((F.size("w") - (k - 1)).alias("total"), F.posexplode(shingle_array("w", k)).alias("pos", "h")))
    anchors = anchors.join(maybe_broadcast(marks, 40), ["k", "h"])
    held = anchors.groupBy("doc_id", "n_words", "k", "m", "total").agg(F.array_sort(F.collect_set("pos")).alias("at"))

    # a window of w shingles shares x with an item of m: x / (w + m - x) >= s, so x >= s (w + m) / (1 + s); only the end of a text cuts it short
    def need(s: Column) -> Column:
        return F.ceil((F.least(F.col("m"), F.col("total") - s) + F.col("m")) * similarity / (100 + similarity)).cast("int")

    starts = F.filter("at", lambda s, i: F.coalesce(F.get("at", i + need(s) - 1) < s + F.col("m"), F.lit(False)))
    likely = held.select("doc_id", "n_words", "k", "m", starts.alias("starts")).filter(F.size("starts") > 0)
    likely = saved(likely.select("doc_id", "k", F.struct("n_words", "m", "starts").alias("of")), "bench-likely")
    wanted = likely.select("doc_id").distinct()
    near = texts.join(maybe_broadcast(wanted, 16), "doc_id", "left_semi")
    views = each_kind(near, lambda k: (shingle_array("w", k).alias("all"),))
    rows = likely.join(views, ["doc_id", "k"]).select("doc_id", "of", "all", F.explode("of.starts").alias("start"))
    rows = rows.select("doc_id", "of.n_words", "start", F.slice("all", F.col("start") + 1, F.col("of.m")).alias("window"))
    out = saved(rows.dropDuplicates(["doc_id", "n_words", "start", "window"]).select("*", simhash("window").alias("window_print")), "bench-windows")
    discard(marks, likely)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): best window of each leaked item."""
    items = saved(items_of(benchmark), "bench-items")
    windows = windows_of(docs, items, similarity)
    pairs = close_items(windows, items).join(windows.drop("window_print"), ["doc_id", "n_words", "start"]).join(items.select("item_id", "n_words", "item"), ["item_id", "n_words"])
    pairs = pairs.filter(F.array_contains("item", F.get("window", F.lit(0))))
    shared = shared_weight("window", "item")
    pairs = pairs.select("doc_id", "item_id", "start", "n_words", shared.alias("x"), (F.size("window") + F.size("item")).alias("sum"))
    pairs = pairs.filter(F.col("x") * 100 >= (F.col("sum") - F.col("x")) * similarity).withColumn("s", F.col("x") / (F.col("sum") - F.col("x")))
    best = pairs.groupBy("doc_id", "item_id", "n_words").agg(F.min(F.struct((-F.col("s")).alias("minus"), F.col("start"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.start").cast("long").alias("start_word"), F.col("n_words").cast("long").alias("n_words"), (-F.col("b.minus")).alias("similarity"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The documents without those that hold a benchmark item."""
    gone = saved(find_leaks(docs, benchmark, similarity).select(F.col("doc_id").alias("_gone")).distinct(), "leaks")
    return docs.join(maybe_broadcast(gone, 16), docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")


ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
bs AS (SELECT item_id, n_words, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, len(w) AS n_words, unnest(range(1, len(w) - 3)) AS i FROM bw)),
bc AS (SELECT item_id, n_words, s, count(*) AS c, n_words - 4 AS m FROM bs GROUP BY item_id, n_words, s),
an AS (SELECT DISTINCT doc_id, item_id, n_words, m, i AS start FROM ds JOIN bc USING (s)),
wc AS (SELECT an.doc_id, an.item_id, an.n_words, an.m, an.start, ds.s, count(*) AS c FROM an JOIN ds ON ds.doc_id = an.doc_id AND ds.i BETWEEN an.start AND an.start + an.m - 1 GROUP BY ALL),
wx AS (SELECT wc.doc_id, wc.item_id, wc.n_words, wc.start, any_value(wc.m) AS m, sum(wc.c) AS n, sum(least(wc.c, coalesce(bc.c, 0))) AS x
       FROM wc LEFT JOIN bc ON bc.item_id = wc.item_id AND bc.s = wc.s GROUP BY wc.doc_id, wc.item_id, wc.n_words, wc.start),
ok AS (SELECT *, x / (n + m - x) AS similarity FROM wx WHERE 100 * x >= 80 * (n + m - x))
SELECT doc_id, item_id, (arg_min(start, (-similarity, start)) - 1)::BIGINT AS start_word, n_words::BIGINT AS n_words, max(similarity) AS similarity FROM ok GROUP BY doc_id, item_id, n_words
"""
