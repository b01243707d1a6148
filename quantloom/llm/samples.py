"""The bounded sample of labelled rows that the two classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import held_out, id_text

#: Bounds of the sample: rows of label 0 and of label 1, and the longest text in it.
#: At most sum(ROWS) * LONGEST characters reach the driver.
ROWS = (1200, 1200)
LONGEST = 6_000


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learned from: never held-out ids, no nulls."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    return known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))


def share_of(labels: DataFrame, label: str) -> float:
    """Share of label 1 among all rows that may be learned from; a half without any."""
    share = known_labels(labels, label).agg(F.avg("label").alias("s")).first()["s"]
    return 0.5 if share is None else min(max(share, 1e-3), 1 - 1e-3)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: tuple[int, int] = ROWS, longest: int = LONGEST) -> list[tuple[str, int]]:
    """(text, label) of up to ``rows`` documents of each label, never of held-out ids.

    Ids are drawn from the label table by a hash order, so no text is sorted and
    reruns draw the same rows; twice as many are drawn as wanted, to make up for
    texts that are too long or missing.  Null labels, ids and texts are left out.
    """
    known = known_labels(labels, label)
    drawn = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows[k]) for k in (0, 1)]
    ids = drawn[0].unionByName(drawn[1]).dropDuplicates(["doc_id"])
    texts = id_text(docs).filter(F.length("text") <= longest)
    # at most 2 * sum(rows) ids, whatever the input: a proven bound for the broadcast
    found = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label", F.xxhash64("doc_id").alias("turn"))
    kept = [r for k in (0, 1) for r in found.filter(F.col("label") == k).orderBy("turn", "doc_id", "text").limit(rows[k]).collect()]
    return [(r["text"], r["label"]) for r in sorted(kept, key=lambda r: (r["doc_id"], r["text"]))]
