"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped edges.

1. Each text becomes its set of distinct five-word shingles.  Equal sets are one
   class; only the smallest doc_id of a class goes on.
2. One-permutation hashing gives ``BINS`` minima from one hash of each shingle;
   empty bins borrow from a full bin by a hash that all texts share (optimal
   densification).  Bands of ``ROWS`` bins are bucket keys.
3. In each bucket of two or more, edges go from every member to one centre: the
   member with the smallest share of shingles that no other candidate has.  A
   star of m members has m - 1 edges where all pairs would be m * (m - 1) / 2.
4. What the stars leave open, members of one bucket in different components, is
   searched without pairing whole buckets.  Linked sets share one of their rarest
   shingles (prefix filter: the n - ceil(similarity * n) + 1 rarest of n).  A
   shingle that at most ``RARE`` candidates have is joined on, so a shingle makes
   few pairs.  Linked sets that this misses share no rare shingle at all, so of n
   shingles with v rare ones they share n - v at most: only members for which
   that is enough, close to what their whole group has in common, are paired in
   their bucket.  So the stars lose no link.
5. Every edge is confirmed on the full sets before it counts.

Sets of fewer than ``least_size`` shingles can only be linked with equal sets at the
threshold, so they need no signature.  Null and empty texts have no shingle and
are linked with nothing.  Rows of one doc_id count as one document; rows without
a doc_id come back with a null component.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import discard, id_text, maybe_broadcast, saved, tidy
from quantloom.llm.components import connected_components
from quantloom.llm.textkernel import U64, mix, shingle_sets, slices, stream

#: Links have 100 * intersection >= SIMILARITY * union.
SIMILARITY = 85
BINS, ROWS = 96, 4
BANDS = BINS // ROWS
#: Candidates that may share a shingle for it to be joined on.
RARE = 16

_TRIES = 256
_DONOR = (mix(np.arange(BINS, dtype=U64)[:, None] * U64(1 << 32) + np.arange(_TRIES, dtype=U64)[None, :] + U64(99)) % U64(BINS)).astype(np.int64)
_FULL = U64(0xFFFFFFFFFFFFFFFF)


def least_size(similarity: int) -> int | None:
    """Shingles of the smallest set that another set, one with a shingle more, can be linked with; None if only equal sets are."""
    return max(1, -(-similarity // (100 - similarity))) if similarity < 100 else None


def signatures(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """(n, BINS) one-permutation minima of the sets given as (text, hash) rows."""
    bins = (hashes >> U64(32)) * U64(BINS) >> U64(32)
    out = np.full(n * BINS, _FULL, dtype=U64)
    np.minimum.at(out, doc * BINS + bins.astype(np.int64), mix(hashes))
    out = out.reshape(n, BINS)
    full = out != _FULL
    rows, empty = np.nonzero(~full & full.any(1)[:, None])
    turn = 0
    while len(rows):
        donor = _DONOR[empty, turn % _TRIES] if turn < _TRIES else (empty + turn - _TRIES + 1) % BINS
        got = full[rows, donor]
        out[rows[got], empty[got]] = out[rows[got], donor[got]]
        rows, empty = rows[~got], empty[~got]
        turn += 1
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(n, BANDS) bucket keys; the band is part of the key."""
    key = np.tile(stream(BANDS, 31), (len(signature), 1))
    for k in range(ROWS):
        key = mix(key + signature[:, k::ROWS])
    return key.view(np.int64)


_SHAPES = "doc_id long, n long, f1 long, f2 long, bands array<long>"


def _shapes(least: int | None):
    """Of each text the number of shingles, a 128-bit print of the set, and from ``least`` shingles on band keys."""

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1)):
                doc, hashes = shingle_sets(part)
                n = len(part)
                size = np.bincount(doc, minlength=n)
                prints = []
                for seed in (U64(0x51), U64(0xA7)):
                    total = np.zeros(n, dtype=U64)
                    if len(doc):
                        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                        total[doc[first]] = np.add.reduceat(mix(hashes ^ seed), first)
                    prints.append(mix(total + size.astype(U64)).view(np.int64))
                big = size >= least if least is not None else np.zeros(n, dtype=bool)
                place = np.cumsum(big) - 1
                use = big[doc]
                keys = band_keys(signatures(place[doc[use]], hashes[use], int(big.sum())))
                offsets = np.r_[0, np.cumsum(np.where(big, BANDS, 0))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(part.first, n), pa.array(size, pa.int64()), pa.array(prints[0]), pa.array(prints[1]),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel())),
                ], names=["doc_id", "n", "f1", "f2", "bands"])

    return run


def _sets(batches):
    for batch in batches:
        for part in slices(batch.column(1)):
            doc, hashes = shingle_sets(part)
            offsets = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(part)))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))], names=["doc_id", "shingles"])


def _possible(na: Column, nb: Column, ua: Column, ub: Column, similarity: int) -> Column:
    """Whether sets of na and nb shingles with ua and ub of their own can be linked."""
    shared = F.least(na - ua, nb - ub)
    return shared * 100 >= (na + nb - shared) * similarity


def _confirmed(edges: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Edges (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    both = edges.join(left, "a").join(right, "b")
    return both.filter(shared * 100 >= (F.size("sa") + F.size("sb") - shared) * similarity).select("a", "b")


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, n_links.

    ``n_links`` counts the confirmed edges at the document's class representative
    (those of stars and of the pairs that stars left open).
    """
    least = least_size(similarity)
    texts = id_text(docs)
    shapes = saved(texts.mapInArrow(tidy(_shapes(least)), _SHAPES), "shapes")
    classes = shapes.filter("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    # The bands of a class are those of its representative; equal sets have equal bands.
    rep_ids = classes.filter(F.col("n") >= least if least is not None else F.lit(False)).select("f1", "f2", F.col("rep").alias("doc_id"))
    members = shapes.join(rep_ids, ["f1", "f2", "doc_id"], "left_semi").select("doc_id", "n", F.explode("bands").alias("key"))
    members = members.dropDuplicates(["key", "doc_id"])
    crowded = members.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    crowd = saved(members.join(crowded, "key"), "buckets")
    wanted = saved(crowd.select("doc_id").distinct(), "bucket-docs")

    # full sets of candidates only, and how many shingles each shares with no other
    own = texts.join(maybe_broadcast(wanted, 16), "doc_id", "left_semi")
    sets = saved(own.mapInArrow(tidy(_sets), "doc_id long, shingles array<long>").groupBy("doc_id").agg(F.max("shingles").alias("shingles")), "shingle-sets")
    spread = saved(sets.select("doc_id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("df"), F.min("doc_id").alias("doc_id")), "shingle-spread")
    alone = saved(spread.filter("df = 1").groupBy("doc_id").agg(F.count("*").alias("u")), "own-shingles")
    buckets = crowd.join(alone, "doc_id", "left").select("key", "doc_id", "n", F.coalesce("u", F.lit(0)).alias("u"))
    # who shares too little with all others together has no link: an exact proof
    buckets = saved(buckets.filter((F.col("n") - F.col("u")) * 100 >= F.col("n") * similarity), "open-buckets")

    centre = buckets.groupBy("key").agg(F.min(F.struct((F.col("u") / F.col("n")).alias("share"), "doc_id", "n", "u")).alias("c"), F.count("*").alias("m")).filter("m > 1")
    centre = centre.select("key", F.col("c.doc_id").alias("c"), F.col("c.n").alias("cn"), F.col("c.u").alias("cu"))
    star = buckets.join(centre, "key").filter((F.col("doc_id") != F.col("c")) & _possible(F.col("n"), F.col("cn"), F.col("u"), F.col("cu"), similarity))
    star = star.select(F.least("doc_id", "c").alias("a"), F.greatest("doc_id", "c").alias("b")).distinct()
    links = saved(_confirmed(star, sets, similarity), "star-links")
    found = saved(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "star-components")

    # What the stars left open: same bucket, different components, link possible.
    named = buckets.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", "u", F.coalesce("component", "doc_id").alias("component"))
    mixed = named.groupBy("key").agg((F.min("component") != F.max("component")).alias("mixed")).filter("mixed").select("key")
    members_left = saved(named.join(mixed, "key"), "open-members")
    open_docs = members_left.select("doc_id", "n", "u", "component").distinct()
    rarest = sets.join(open_docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    rarest = rarest.join(spread.filter("df > 1").select("s", "df"), "s", "left").select("doc_id", "n", F.struct(F.coalesce("df", F.lit(1)).alias("df"), "s").alias("x"))
    length = (F.col("n") - F.ceil(F.col("n") * similarity / 100) + 1).cast("int")
    rarest = rarest.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list("x")).alias("x"))
    rare = F.size(F.filter("x", lambda e: e["df"] <= RARE))
    rarest = rarest.select("doc_id", rare.alias("v"), F.slice("x", F.lit(1), length).alias("x"))
    rarest = saved(rarest.join(open_docs, "doc_id").select("doc_id", "n", "u", "v", "component", F.filter("x", lambda e: (e["df"] > 1) & (e["df"] <= RARE))["s"].alias("rare"), (F.element_at("x", -1)["df"] > RARE).alias("core")), "rarest")

    def sides(rows: DataFrame, key: str) -> DataFrame:
        left = rows.select(F.col(key).alias("a_key"), *(F.col(c).alias(f"a_{c}") for c in ("doc_id", "n", "u", "component")))
        right = rows.select(F.col(key).alias("b_key"), *(F.col(c).alias(f"b_{c}") for c in ("doc_id", "n", "u", "component")))
        possible = _possible(F.col("a_n"), F.col("b_n"), F.col("a_u"), F.col("b_u"), similarity)
        on = (F.col("a_key") == F.col("b_key")) & (F.col("a_doc_id") < F.col("b_doc_id")) & (F.col("a_component") != F.col("b_component")) & possible
        return left.join(right, on).select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b"))

    by_shingle = sides(rarest.select("doc_id", "n", "u", "component", F.explode("rare").alias("s")), "s")
    core = rarest.filter(F.col("core") & ((F.col("n") - F.col("v")) * 100 >= F.col("n") * similarity)).select("doc_id", "n", F.col("v").alias("u"), "component")
    by_bucket = sides(members_left.select("key", "doc_id").join(core, "doc_id"), "key")
    pairs = by_shingle.unionAll(by_bucket).distinct().join(star, ["a", "b"], "left_anti")
    more = saved(_confirmed(pairs, sets, similarity), "open-links")
    every = links.unionAll(more)
    reached = connected_components(every.select(F.col("a").alias("u"), F.col("b").alias("v")))
    degree = every.select("a").unionAll(every.select("b")).groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("n_links"))
    named = classes.join(reached.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    named = saved(named.select("f1", "f2", F.coalesce("component", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")

    discard(crowd, wanted, sets, spread, alone, buckets, links, members_left, rarest, more)
    full = shapes.filter("n > 0 and doc_id is not null").join(named, ["f1", "f2"]).select("doc_id", "n", "component", "n_links")
    rest = shapes.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component"), F.lit(0).cast("long").alias("n_links"))
    return full.unionAll(rest).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"), "n_links")


def drop_near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The documents, one of each group, with all their columns.

    Of several rows with the kept doc_id one stays.
    """
    marks = saved(near_duplicates(docs, similarity).filter("doc_id is not null"), "dedup-marks")
    gone = marks.filter("not kept").select("doc_id").distinct()
    key = docs["doc_id"].cast("long")
    kept = docs.join(maybe_broadcast(gone.withColumnRenamed("doc_id", "_gone"), 16), key == F.col("_gone"), "left_anti")
    again = marks.filter("kept").groupBy("doc_id").agg(F.count("*").alias("m")).filter("m > 1").limit(1).count()
    if not again:
        return kept
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionAll(kept.filter("doc_id is null"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 85 * (na.n + nb.n - x)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node WHERE r.root < e.v),
c AS (SELECT node AS doc_id, min(root) AS component_id FROM r GROUP BY node)
SELECT c.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
