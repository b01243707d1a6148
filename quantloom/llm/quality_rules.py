"""Quality rules: a threshold table compiled into one Spark projection.

Measures are built-in expressions only.  ``THRESHOLDS`` is data: each row names
a ratio (numerator and denominator), the bounds it must keep and the smallest text
it applies to; ``verdict`` compiles the table into one boolean expression.

Null or empty texts have zero words and fail the base rule.  All other columns
of the input are ignored, repeated rows are measured one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import GAP, GAP_CHARS, id_text

WINDOW = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Frequent function words of English, German, French, Spanish,
# Italian, Portuguese and Dutch.
STOP_WORDS = (
    "the of and to in a is that it for on with as was by this be are from or an not "
    "der die das und in zu den von ist mit des sich auf ein eine nicht im dem für "
    "le la les de des et un une en que qui pour dans est sur pas par au avec du "
    "el los las y se del al con por una su para lo como no "
    "il di che e per non sono da "
    "o os do da em um uma com não "
    "het een van en op te dat niet"
)


@dataclass(frozen=True)
class Threshold:
    """``low <= 1000 * top / bottom <= high`` for texts of ``at_least`` words or more."""

    name: str
    top: str
    bottom: str
    low: int | None
    high: int | None
    at_least: int = 0


#: Bounds in thousandths, so that the verdict is integer arithmetic.
THRESHOLDS = (
    Threshold("mean_word_length", "word_chars", "n_words", 1500, 20000),
    Threshold("symbols_per_word", "n_symbols", "n_words", None, 250),
    Threshold("duplicate_lines", "n_dup_lines", "n_lines", None, 700),
    Threshold("stop_words_per_word", "n_stop_words", "n_words", 60, None, 100),
    Threshold("words_per_line", "n_words", "n_lines", 2000, None),
)


def stop_words() -> list[str]:
    return list(dict.fromkeys(STOP_WORDS.split()))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of the table; every expression is a built-in function."""
    gap, text = F.lit(GAP_CHARS), F.coalesce("text", F.lit(""))
    step = id_text(docs).select("doc_id", text.alias("text"))
    step = step.select("doc_id", "text", F.btrim("text", gap).alias("_core"), F.split("text", "\n").alias("_lines"))
    step = step.select(
        "doc_id",
        F.length(F.regexp_replace("_core", GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_core", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter("_lines", lambda x: F.btrim(x, gap) != "").alias("_lines"),
        F.when(F.col("_core") == "", F.array().cast("array<string>")).otherwise(F.split("_core", GAP)).alias("_words"),
    )
    word = lambda i: F.get("_words", i)
    # (hash) of each window of five words, by its first word
    windows = F.when(
        F.size("_words") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*[word(i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<long>"))
    is_stop = lambda w: F.translate(w, _UPPER, _LOWER).isin(stop_words())
    step = step.select(
        "doc_id", "word_chars", "n_symbols", F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", is_stop)).cast("long").alias("n_stop_words"), windows.alias("_windows"),
    )
    # Only texts with a window twice are sorted: (hash, place), neighbours of equal hash are repeats.
    pairs = F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    step = step.select("*", pairs.alias("_pairs")).drop("_windows")
    same = lambda e, i: F.get("_pairs", i)["h"] == e["h"]
    places = F.array_sort(F.transform(
        F.filter("_pairs", lambda e, i: ((i > 0) & same(e, F.greatest(i - 1, F.lit(0)))) | F.coalesce(same(e, i + 1), F.lit(False))),
        lambda e: e["i"],
    ))
    step = step.select("*", places.alias("_places")).drop("_pairs")
    # a repeated window covers five words, less where the next repeated one begins sooner
    covered = F.aggregate(
        F.transform("_places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x,
    )
    return step.select("*", covered.cast("long").alias("n_repeat_words")).drop("_places")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def verdict(thresholds: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """The threshold table as one expression: true where no bound is broken."""
    good = F.lit(True)
    for rule in thresholds:
        top, bottom = F.col(rule.top) * 1000, F.col(rule.bottom)
        holds = F.lit(True)
        if rule.low is not None:
            holds = holds & (top >= bottom * rule.low)
        if rule.high is not None:
            holds = holds & (top <= bottom * rule.high)
        good = good & ((F.col("n_words") < rule.at_least) | holds)
    return good


def quality_rules(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """One row per document: counts, ``base_failed`` and ``kept``.

    Null and empty texts: all counts 0, base_failed true, kept false.
    """
    return measures(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
        base_failed().alias("base_failed"), (~base_failed() & verdict(thresholds)).alias("kept"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
v AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
             len(ls)::BIGINT AS n_lines,
             len(list_filter(ws, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN (STOPS)))::BIGINT AS n_stop_words
      FROM w LEFT JOIN v USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND RULES AS kept FROM b
"""


def oracle(thresholds: tuple[Threshold, ...] = THRESHOLDS) -> str:
    rules = []
    for r in thresholds:
        bounds = [f"{r.top} * 1000 >= {r.bottom} * {r.low}"] * (r.low is not None) + [f"{r.top} * 1000 <= {r.bottom} * {r.high}"] * (r.high is not None)
        rules.append(f"(n_words < {r.at_least} OR ({' AND '.join(bounds)}))")
    return ORACLE.replace("STOPS", ", ".join(f"'{w}'" for w in stop_words())).replace("RULES", "(" + " AND ".join(rules) + ")")
