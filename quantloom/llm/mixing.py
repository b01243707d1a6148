"""Mixing sources to target weights by Pareto order sampling.

Targets share out a total by weight, capped at a multiple of each source's size
(the excess is shared again).  Within a source a document's expected copies grow
with the binary length of its size (long documents come more often than short
ones), scaled so that the expected words meet the source's target, and never above
``most``.  Whole copies are certain; for the fraction p that is left, documents are
ranked by random odds over inclusion odds, u / (1 - u) divided by p / (1 - p).  The
sample is of fixed size in words: documents are taken in that order until one does
not fit, then further on in the same order among those that still fit (``PASSES``
times in all), and one more document, of the size nearest to the gap, closes it.

The random number of a document is a hash of its doc_id and a seed, so reruns agree.
The running sums go through a histogram of the rank, so no source is sorted in one
task: only the histogram cell on the border is.  Sources are numbered by range
partitions, and the level that all uncapped sources share is found by aggregations,
so any number of sources will do.

Null texts have size 0; a null source is a source of its own, last in order.
Repeated doc_ids are taken or left together.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import discard, maybe_broadcast, saved

WEIGHTS = (5, 2, 1)
TOTAL = 1.5
MOST = 2
CELLS = 1 << 14
PASSES = 2
#: Bytes of a plan row beside its source's name.
PLAN_BYTES = 600
WORD = r"[^\x20\x09-\x0D]+"


def binary_length(size: Column) -> Column:
    """Digits of a size as a binary number: 1 for 0 and 1, at most 63."""
    return F.length(F.bin(size))


def sizes(docs: DataFrame, keep: tuple[str, ...] = (), seed: str = "") -> DataFrame:
    """doc_id, source, size in words, and the random number of each document; and columns to keep."""
    number = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))).cast("binary")), 1, 12), 16, 10).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ((number + F.lit(0.5)) / F.lit(float(1 << 48))).alias("u"), *keep,
    )


def source_bytes(rows: DataFrame, name: str = "source", row_bytes: int = PLAN_BYTES) -> int:
    """Measured bytes of a saved frame with one row (or a few) for each source."""
    row = rows.agg(F.sum(F.coalesce(F.octet_length(name), F.lit(0)) + F.lit(row_bytes)).alias("b")).first()
    return row["b"] or 0


def _numbered(by_source: DataFrame) -> DataFrame:
    """Sources with their place by code point, null last; no task sorts them all."""
    order = (F.col("source").isNull(), F.col("source"))
    parts = by_source.repartitionByRange(*[o.asc() for o in order]).sortWithinPartitions(*[o.asc() for o in order])
    parts = saved(parts.select("*", F.monotonically_increasing_id().alias("at")), "mix-sources")
    part = F.shiftright("at", 33)
    counts = sorted((r["part"], r["n"]) for r in parts.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row a partition
    before, total = F.lit(0).cast("long"), 0
    for number, n in counts:
        before, total = F.when(part == number, F.lit(total).cast("long")).otherwise(before), total + n
    return parts.select("source", "source_size", (before + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """source, source_size, target; ``by_source`` has one row (source, source_size) for each source."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int") + 1)
    rows = _numbered(by_source).select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    words = rows.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    # Sources above the level get their cap; what is left lifts the level of the others, until no more are capped.
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") < F.col("w") * F.lit(level)
        now = rows.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("cap"))).alias("cap"), F.sum(F.when(~above, F.col("w"))).alias("w")).first()
        if now["n"] == capped or not now["w"]:
            break
        level, capped = (words * total - (now["cap"] or 0.0)) / now["w"], now["n"]
    return rows.select("source", "source_size", F.round(F.least("cap", F.col("w") * F.lit(level)), 6).alias("target"))


def expected_copies(own: DataFrame, weights: tuple[int, ...], total: float, most: int) -> DataFrame:
    """One row for each (source, binary length of a size): target, whole copies, p, and the source's words to draw.

    The expected copies of length L are min(most, c * L); c is where they meet the target.
    """
    classes = saved(own.groupBy("source", binary_length(F.col("size")).alias("length")).agg(F.sum("size").alias("words")), "mix-classes")
    heavy = source_bytes(classes)
    goal = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total, most)
    goal = saved(goal, "mix-targets")
    goal = goal.select(F.col("source").alias("g_source"), "source_size", "target")
    rows = classes.join(maybe_broadcast(goal, heavy, rows=False), F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")
    longer = Window.partitionBy("source").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("source")
    weighed = F.col("words") * F.col("length")
    rows = rows.select("*", F.coalesce(F.sum("words").over(longer), F.lit(0)).alias("full"), (F.sum(weighed).over(all_) - F.coalesce(F.sum(weighed).over(longer), F.lit(0))).alias("open"))
    slope = (F.col("target") - F.lit(float(most)) * F.col("full")) / F.col("open")
    rows = rows.withColumn("c", F.when((F.col("open") > 0) & (slope * F.col("length") <= F.lit(float(most))), slope))
    # the first length, from the longest on, that is not capped sets c for all shorter ones; none: all are capped
    c = F.max(F.when(F.col("c").isNotNull(), F.struct("length", "c"))).over(all_)["c"]
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.coalesce(c * F.col("length"), F.lit(float(most))))).otherwise(0.0)
    rows = rows.select("source", "length", "source_size", "target", "words", copies.alias("copies"))
    rows = rows.withColumn("whole", F.floor(F.col("copies") + F.lit(1e-12)).cast("long"))
    rows = rows.withColumn("p", F.greatest(F.col("copies") - F.col("whole"), F.lit(0.0)))
    room = F.round(F.col("target") - F.sum(F.col("whole") * F.col("words")).over(all_), 6)
    return rows.select("source", "length", "source_size", "target", "whole", "p", room.alias("room"))


def rank(u: Column, p: Column) -> Column:
    """r / (1 + r) of the Pareto rank r = (u / (1 - u)) / (p / (1 - p)): the same order, between 0 and 1."""
    return u * (1 - p) / (u * (1 - p) + p * (1 - u))


def _by_source(rows: DataFrame, side: DataFrame, name: str, size: int, how: str = "left") -> DataFrame:
    return rows.join(maybe_broadcast(side, size, rows=False), F.col("source").eqNullSafe(F.col(name)), how)


def source_plan(own: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """One row for each source, which decides on every document by itself.

    ``own`` is a saved frame of ``sizes``.  ``lengths`` maps binary lengths to target copies;
    a document gets its whole copies, and one more if a pass of ``cuts`` takes it (its size
    is at most ``limit`` and its (rank, doc_id, size) at most ``cut``) or if it is the filler.
    """
    plan = saved(expected_copies(own, weights, total, most), "mix-copies")
    heavy = source_bytes(plan)
    joined = own.join(maybe_broadcast(plan.select(F.col("source").alias("p_source"), "length", "p", "room"), heavy, rows=False), F.col("source").eqNullSafe(F.col("p_source")) & (binary_length(F.col("size")) == F.col("length")))
    open_ = joined.filter("p > 0 and size > 0 and room > 0").select("source", "doc_id", "size", rank(F.col("u"), F.col("p")).alias("v"))
    open_ = saved(open_.select("*", F.floor(F.col("v") * CELLS).cast("int").alias("cell")), "mix-ranked")

    # one row a source: words left, and the cut of every pass
    key = F.struct("v", "doc_id", "size")
    state = saved(plan.filter("room > 0").select(F.col("source").alias("s_source"), "room").distinct(), "mix-room")
    light = source_bytes(state, "s_source")
    states = []
    for turn in range(PASSES):
        rows = _by_source(open_, state.select("s_source", "room", *[c for c in state.columns if c.startswith(("limit", "cut"))]), "s_source", light, "inner")
        rows = rows.filter(~_taken(key, F.col("size"), turn) & ((F.col("size") <= F.col("room")) if turn else F.lit(True)))
        cells = rows.groupBy("source", "cell", "room").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
        over = cells.select("source", "cell", "room", "words", upto.alias("upto")).filter(F.col("upto") > F.col("room"))
        border = over.groupBy(F.col("source").alias("b_source")).agg(F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("before"))).alias("b"))
        rows = _by_source(rows, border, "b_source", light)
        free = rows.filter(F.col("b").isNull() | (F.col("cell") < F.col("b.cell"))).select("source", "v", "doc_id", "size")
        order = Window.partitionBy("source").orderBy("v", "doc_id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        tight = rows.filter(F.col("cell") == F.col("b.cell")).withColumn("upto", F.sum("size").over(order) + F.col("b.before"))
        fits = free.unionAll(tight.filter(F.col("upto") <= F.col("room")).select("source", "v", "doc_id", "size"))
        cut = fits.groupBy(F.col("source").alias("c_source")).agg(F.max(key).alias(f"cut{turn}"), F.sum("size").alias("words"))
        after = state.join(cut, F.col("s_source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
        limit = F.col("room") if turn else F.lit(float("inf"))
        after = after.withColumn(f"limit{turn}", limit).withColumn("room", F.col("room") - F.coalesce("words", F.lit(0))).drop("words")
        states.append(state)
        state = saved(after, f"mix-state-{turn}")
    rows = _by_source(open_, state, "s_source", light, "inner").filter(~_taken(key, F.col("size"), PASSES))
    off = F.abs(F.col("size") - F.col("room"))
    fill = rows.filter(off < F.col("room")).groupBy(F.col("source").alias("f_source")).agg(F.min(F.struct(off.alias("off"), "v", "doc_id", "size")).alias("f"))
    lengths = plan.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.map_from_entries(F.collect_list(F.struct("length", F.struct("whole", "p")))).alias("lengths"))
    out = lengths.join(state.drop("room"), F.col("source").eqNullSafe(F.col("s_source")), "left").join(fill, F.col("source").eqNullSafe(F.col("f_source")), "left")
    out = saved(out.select(F.col("source").alias("m_source"), "source_size", "target", "lengths", *[c for i in range(PASSES) for c in (f"limit{i}", f"cut{i}")], F.col("f.doc_id").alias("f_id"), F.col("f.size").alias("f_size"), F.col("f").isNotNull().alias("hit")), "mix-plan")
    discard(plan, open_, state, *states)
    return out


def _taken(key: Column, size: Column, turns: int) -> Column:
    out = F.lit(False)
    for i in range(turns):
        out = out | F.coalesce((size <= F.col(f"limit{i}")) & (key <= F.col(f"cut{i}")), F.lit(False))
    return out


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of ``sizes`` with the plan of their source and ``_copies``; no row is shuffled while the plan is small.

    A plan row holds at most 63 lengths of some 30 bytes.
    """
    side = maybe_broadcast(plan, source_bytes(plan, "m_source", PLAN_BYTES + 30 * 63), rows=False)
    own = rows.join(side, F.col("source").eqNullSafe(F.col("m_source")))
    mine = F.col("lengths")[binary_length(F.col("size"))]
    v = rank(F.col("u"), mine["p"])
    drawn = (mine["p"] > 0) & (F.col("size") > 0) & _taken(F.struct(v.alias("v"), F.col("doc_id"), F.col("size")), F.col("size"), PASSES)
    filler = F.col("hit") & F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("size") == F.col("f_size"))
    return own.withColumn("_copies", mine["whole"] + (F.coalesce(drawn, F.lit(False)) | F.coalesce(filler, F.lit(False))).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST, seed: str = "") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, p, copies, taken."""
    own = saved(sizes(docs, seed=seed), "mix-sizes")
    out = with_copies(own, source_plan(own, weights, total, most))
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("lengths")[binary_length(F.col("size"))]["p"].alias("p"), F.col("_copies").cast("long").alias("copies"), (F.col("_copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken."""
    own = saved(sizes(docs), "mix-sizes")
    plan = source_plan(own)
    discard(own)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    number = sizes(rows.select(F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"), F.col("_row.source").alias("source"), "_row"), keep=("_row",))
    found = with_copies(number, plan).filter("_copies > 0")
    return found.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


def _oracle() -> str:
    """Plain SQL: sources filled from the first to reach its cap, every pass a running sum over whole sources."""
    sql = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS size,
                  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
a AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS place FROM s),
b AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM a),
c AS (SELECT *, cap / w AS reach, 1.5::DOUBLE * sum(source_size) OVER () AS t, sum(w) OVER () AS sw,
             coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
             coalesce(sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb FROM b),
e AS (SELECT *, (SELECT arg_min((t - cb) / (sw - wb), (reach, place)) FROM c WHERE (t - cb) / (sw - wb) <= reach) AS level FROM c),
p AS (SELECT source, source_size, round(least(cap, w * coalesce(level, 'inf'::DOUBLE)), 6) AS target FROM e),
l AS (SELECT source, length(bin(size)) AS length, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
lw AS (SELECT l.*, p.source_size, p.target,
              coalesce(sum(words) OVER (PARTITION BY l.source ORDER BY length DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_words,
              (sum(words * length) OVER (PARTITION BY l.source ORDER BY length ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS open_words
       FROM l JOIN p ON l.source IS NOT DISTINCT FROM p.source),
lc AS (SELECT *, CASE WHEN open_words > 0 AND (target - 2.0::DOUBLE * full_words) / open_words * length <= 2.0 THEN (target - 2.0::DOUBLE * full_words) / open_words END AS c FROM lw),
le AS (SELECT *, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, coalesce((arg_max(c, length) FILTER (c IS NOT NULL) OVER (PARTITION BY source)) * length, 2.0::DOUBLE)) ELSE 0.0::DOUBLE END AS copies FROM lc),
lp AS (SELECT *, floor(copies + 1e-12::DOUBLE)::BIGINT AS whole, greatest(copies - floor(copies + 1e-12::DOUBLE), 0.0::DOUBLE) AS p FROM le),
lr AS (SELECT *, round(target - (sum(whole * words) OVER (PARTITION BY source))::BIGINT, 6) AS room FROM lp),
f AS (SELECT d.doc_id, d.source, d.size, lr.source_size, lr.target, lr.whole, lr.p, lr.room,
             d.u * (1 - lr.p) / (d.u * (1 - lr.p) + lr.p * (1 - d.u)) AS v, lr.p > 0 AND d.size > 0 AND lr.room > 0 AS able
      FROM d JOIN lr ON d.source IS NOT DISTINCT FROM lr.source AND length(bin(d.size)) = lr.length),
g0 AS (SELECT *, 0 AS extra FROM f),
"""
    for i in range(1, PASSES + 1):
        fits = "able AND extra = 0" + (" AND size <= room" if i > 1 else "")
        sql += f"""h{i} AS (SELECT *, CASE WHEN {fits} THEN sum(CASE WHEN {fits} THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY v, doc_id, size RANGE UNBOUNDED PRECEDING) END AS upto FROM g{i - 1}),
k{i} AS (SELECT * REPLACE (CASE WHEN upto <= room THEN 1 ELSE extra END AS extra), coalesce(sum(size) FILTER (upto <= room) OVER (PARTITION BY source), 0) AS words FROM h{i}),
g{i} AS (SELECT doc_id, source, size, source_size, target, whole, p, room - words::BIGINT AS room, v, able, extra FROM k{i}),
"""
    last = PASSES
    return sql + f"""z AS (SELECT source, arg_min(doc_id, (abs(size - room), v, doc_id, size)) AS doc_id FROM g{last} WHERE able AND extra = 0 AND abs(size - room) < room GROUP BY source),
y AS (SELECT g{last}.*, whole + CASE WHEN z.doc_id IS NOT NULL THEN 1 ELSE extra END AS copies FROM g{last} LEFT JOIN z ON g{last}.doc_id = z.doc_id)
SELECT doc_id, source, size, source_size, target, p, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken FROM y
"""


ORACLE = _oracle()
