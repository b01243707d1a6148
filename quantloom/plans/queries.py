"""One query for each operator over the driver's tables, and the SQL that checks it.

Row order in these tables is the natural total order of their keys, so DuckDB can
follow it.  Absence is made with the same conditions on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions import sequences, text
from quantloom.functions.unimod import TABLE
from quantloom.functions.values import (
    Notation, as_number, decode_factor, drop_tokens, encode_factor, normalize_missing, remap_strict, sentinel, strict_number, to_boolean, to_double, to_long,
)
from quantloom.operators import align, annotate, axis, cells, joins, layers, layout, prepare, reshape, stats
from quantloom.operators.axis import Policy, q
from quantloom.operators.cells import CellPolicy
from quantloom.operators.layers import FactorLayer, NumericLayer

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
O = "struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey)"  # noqa: E741
CELL = ["l_partkey", "l_suppkey"]


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").withColumn("_ord", F.struct(*ORDER))


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ cells
@query("SELECT l_partkey, l_suppkey, round(sum(l_quantity), 6) AS quantity, round(sum(l_extendedprice), 6) AS price FROM lineitem GROUP BY ALL")
def cells_sum(spark, d):
    """Repeated cells summed: part by supplier."""
    out = cells.sum_cells(lines(spark, d), CELL, ["l_quantity", "l_extendedprice"])
    return out.select(*CELL, F.round("l_quantity", 6).alias("quantity"), F.round("l_extendedprice", 6).alias("price"))


flagship = cells_sum


@query("SELECT l_partkey, l_suppkey, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def cells_repeated(spark, d):
    return cells.repeated(lines(spark, d), CELL)


@query(f"SELECT l_partkey, l_suppkey, arg_min(l_extendedprice, struct_pack(m := -l_discount, o := {O})) AS price, arg_min(l_tax, struct_pack(m := -l_discount, o := {O})) AS tax, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY ALL")
def cells_keep_best(spark, d):
    rows = lines(spark, d)
    out = cells.keep_best(rows, CELL, ["l_extendedprice", "l_tax", "l_quantity"], CellPolicy("keep_best", "l_discount", "highest", ("l_quantity",)), "_ord")
    return out.select(*CELL, F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"), F.round("l_quantity", 6).alias("quantity"))


@query(f"SELECT l_orderkey, l_partkey, arg_min(CASE WHEN l_linenumber > 1 THEN (l_orderkey % 7)::DOUBLE END, {O}) FILTER (l_linenumber > 1) AS value FROM lineitem GROUP BY ALL")
def cells_same(spark, d):
    """Equal values are kept once; empty rows give way."""
    rows = lines(spark, d).withColumn("value", F.when(F.col("l_linenumber") > 1, (F.col("l_orderkey") % 7).cast("double")))
    cells.require_same(rows, ["l_orderkey", "l_partkey"], ["value"])
    return cells.keep_same(rows, ["l_orderkey", "l_partkey"], ["value"], "_ord").drop("_ord")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def cells_error(spark, d):
    """A table without repeats passes the strict policy unchanged."""
    rows = t(spark, d, "orders").withColumn("_ord", F.col("o_orderkey"))
    return cells.resolve(rows, ["o_orderkey", "o_custkey"], ["o_totalprice"], CellPolicy("error"), "_ord").drop("_ord")


# ------------------------------------------------------------------- axes
@query(f"SELECT l_partkey, arg_min(l_shipdate, {O}) AS l_shipdate, arg_min(l_returnflag, {O}) AS l_returnflag FROM lineitem GROUP BY l_partkey")
def axis_first_row(spark, d):
    return axis.build_axis(lines(spark, d), ["l_partkey"], ["l_shipdate", "l_returnflag"], "_ord").drop("_ord")


@query(f"""SELECT l_partkey, arg_min(l_returnflag, {O}) AS l_returnflag, count(DISTINCT l_returnflag) > 1 AS flags_differ,
 arg_min(l_tax, struct_pack(v := l_tax, o := {O})) FILTER (l_tax > 0) AS l_tax, max(l_discount) AS l_discount,
 arg_min(l_shipdate, struct_pack(m := -l_quantity, o := {O})) AS l_shipdate FROM (SELECT *  FROM lineitem) GROUP BY l_partkey""")
def axis_value_policies(spark, d):
    """first with disagreement, min, max and best_row in one aggregation."""
    rows = lines(spark, d).withColumn("l_tax", F.when(F.col("l_tax") > 0, F.col("l_tax")))
    out = axis.build_features(rows, ["l_partkey"], {"l_returnflag": Policy("first"), "l_tax": Policy("min"), "l_discount": Policy("max"), "l_shipdate": Policy("best_row", "l_quantity", "highest")}, "_ord")
    return out.select("l_partkey", "l_returnflag", q("l_returnflag?").alias("flags_differ"), "l_tax", "l_discount", "l_shipdate")


@query("SELECT p_type AS key, min(p_retailprice::VARCHAR) IS NOT NULL AS has, arg_min(p_retailprice::VARCHAR, struct_pack(p := p_retailprice, k := p_partkey)) AS low FROM part GROUP BY p_type")
def axis_extreme_text(spark, d):
    """Minimum by number that keeps the text as written."""
    rows = t(spark, d, "part").select(F.col("p_type").alias("key"), F.col("p_retailprice").cast("string").alias("low"), F.col("p_partkey").alias("_ord"))
    return axis.build_features(rows, ["key"], {"low": Policy("min")}, "_ord").select("key", F.col("low").isNotNull().alias("has"), "low")


@query(f"""WITH p AS (SELECT l_suppkey, l_shipmode, min({O}) AS o FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY ALL),
g AS (SELECT l_suppkey, count(*) AS n, list(l_shipmode ORDER BY o) AS l FROM p GROUP BY l_suppkey)
SELECT l_suppkey, n AS n_values, array_to_string(l[1:5], ',') AS examples FROM g WHERE n > 1""")
def axis_disagreements(spark, d):
    rows = lines(spark, d).withColumn("mode", F.concat("l_returnflag", "l_linestatus"))
    out = axis.disagreements(rows, ["l_suppkey"], "mode", "_ord")
    return out.select("l_suppkey", "n_values", F.array_join("examples", ",").alias("examples"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, {O}) = 1")
def axis_best_rows(spark, d):
    """Semi join of rows with the best row of each key."""
    return axis.best_rows(lines(spark, d), ["l_suppkey"], "l_extendedprice", "highest", "_ord").select(*ORDER)


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS obs_pos FROM supplier WHERE s_acctbal > 0")
def axis_positions(spark, d):
    """Dense positions of the axis rows that survive, in row order."""
    rows = t(spark, d, "supplier").withColumn("key", F.when(F.col("s_acctbal") > 0, F.col("s_suppkey")))
    return axis.positions(axis.complete_keys(rows, ["key"]), "s_suppkey", "obs_pos").select("s_suppkey", "obs_pos")


@query("""WITH a AS (SELECT k, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS pos FROM (SELECT DISTINCT nullif(l_suppkey % 10, 0) AS k FROM lineitem))
SELECT pos, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem JOIN a ON nullif(l_suppkey % 10, 0) IS NOT DISTINCT FROM a.k GROUP BY pos""")
def axis_factorize(spark, d):
    """Null-safe key to position join; a missing key is an identity."""
    rows = lines(spark, d).withColumn("k", F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey") % 10))
    own = axis.positions(rows.groupBy("k").count(), "k", "pos")
    found = axis.to_positions(rows, own, ["k"], "pos")
    return found.groupBy("pos").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


@query("SELECT o_orderpriority, count(*) AS n_rows FROM orders GROUP BY 1 HAVING count(*) > 1")
def axis_duplicates(spark, d):
    return cells.repeated(t(spark, d, "orders"), ["o_orderpriority"])


# ----------------------------------------------------------------- layouts
@query("SELECT l_partkey AS part, 'A' AS sample, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 6) AS quantity FROM lineitem GROUP BY 1 UNION ALL SELECT l_partkey, 'N', round(sum(l_quantity) FILTER (l_returnflag = 'N'), 6) FROM lineitem GROUP BY 1 UNION ALL SELECT l_partkey, 'R', round(sum(l_quantity) FILTER (l_returnflag = 'R'), 6) FROM lineitem GROUP BY 1")
def layout_wide_long(spark, d):
    """Pivot to a wide table, then header-driven unpivot back."""
    long = lines(spark, d).groupBy(F.col("l_partkey").alias("part"), "l_returnflag").agg(F.sum("l_quantity").alias("v"))
    wide = layout.widen(long, ["part"], "l_returnflag", "v", ["A", "N", "R"]).select("part", *[F.col(c).alias(f"quantity {c}") for c in "ANR"]).withColumn("_ord", F.col("part"))
    samples = layout.match_samples(wide.columns, {"quantity": r"^quantity (?P<sample>.+)$"})
    out = layout.wide_facts(wide, ["part"], samples, ["quantity"], "_ord")
    return out.select("part", "sample", F.round("quantity", 6).alias("quantity"))


@query("""WITH p AS (PIVOT (SELECT l_partkey, l_linestatus, l_quantity FROM lineitem) ON l_linestatus IN ('F', 'O') USING sum(l_quantity) GROUP BY l_partkey)
SELECT l_partkey, round(F, 6) AS F, round(O, 6) AS O FROM p""")
def layout_pivot(spark, d):
    long = lines(spark, d).groupBy("l_partkey", "l_linestatus").agg(F.sum("l_quantity").alias("v"))
    out = layout.widen(long, ["l_partkey"], "l_linestatus", "v", ["F", "O"])
    return out.select("l_partkey", F.round("F", 6).alias("F"), F.round("O", 6).alias("O"))


@query("""SELECT vec_id, 'frag_' || i AS label, nullif(trim(a[i]), '') AS value, nullif(trim(b[i]), '') AS twice FROM (
 SELECT vec_id, generate_subscripts(embedding, 1) AS i, list_transform(embedding, lambda x: round(x, 3)::VARCHAR) AS a, list_transform(embedding, lambda x: (x > 0)::VARCHAR) AS b FROM embeddings) WHERE i <= 4""")
def layout_packed(spark, d):
    """Parallel packed lists to rows, labelled by position."""
    own = t(spark, d, "embeddings").select("vec_id", F.col("vec_id").alias("_ord"), F.transform("embedding", lambda x: F.format_string("%.3f", x.cast("double"))).alias("e"), F.transform("embedding", lambda x: (x > 0).cast("string")).alias("s"))
    packed = own.select("vec_id", "_ord", F.concat(F.array_join("e", ";"), F.lit(";")).alias("p"), F.array_join("s", ";").alias("s"))
    layout.require_parallel(packed, {"p": ";", "s": ";"}, ["vec_id"])
    out = layout.packed_facts(packed, ["vec_id"], {"value": "p", "twice": "s"}, ";", "_ord")
    return out.select("vec_id", "label", "value", "twice")


_SQL["layout_packed"] = """SELECT vec_id, 'frag_' || i AS label, printf('%.3f', embedding[i]::DOUBLE) AS value, CASE WHEN embedding[i] > 0 THEN 'true' ELSE 'false' END AS twice
 FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""


@query("SELECT p_partkey, len(string_split(p_type, ' '))::BIGINT AS n_tokens, length(p_name) - length(replace(p_name, 'a', '')) AS n_a, split_part(p_type, ' ', 1) AS head FROM part")
def packed_counts(spark, d):
    return t(spark, d, "part").select("p_partkey", text.packed_count(F.col("p_type"), " ").cast("long").alias("n_tokens"), text.count_literal(F.col("p_name"), "a").alias("n_a"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("head"))


@query("SELECT n_name AS name, n_regionkey::DOUBLE AS region, NULL::VARCHAR AS comment FROM nation UNION ALL BY NAME SELECT r_name AS name, NULL AS region, upper(r_name) AS comment FROM region")
def layout_union_fill(spark, d):
    a = t(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("double").alias("region"))
    b = t(spark, d, "region").select(F.col("r_name").alias("name"), F.upper("r_name").alias("comment"))
    return layout.union_all([a, b], fill=True)


@query("SELECT user_id, min(event_id) AS first_event FROM events GROUP BY user_id")
def layout_ordered_distinct(spark, d):
    return layout.ordered_distinct(t(spark, d, "events"), ["user_id"], "event_id").withColumnRenamed("event_id", "first_event")


# ------------------------------------------------------------------ values
@query("SELECT event_id, regexp_extract(props, '\"k\": (\\d+)', 1)::DOUBLE AS k FROM events")
def values_regex_layer(spark, d):
    rows = t(spark, d, "events")
    layer = NumericLayer("props", pattern=r'"k": (\d+)')
    return rows.select("event_id", layer.parsed(rows).alias("k"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE -1 END AS code, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'view' END AS label FROM events")
def values_factor(spark, d):
    codes = {"click": 0, "view": 1}
    code = encode_factor(F.col("event_type"), codes)
    return t(spark, d, "events").select("event_id", code.alias("code"), decode_factor(code, codes).alias("label"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount <= 0.02 OR l_tax = 0.05 THEN NULL ELSE l_discount END AS discount,
 NOT (l_discount <= 0.02) AS claims FROM lineitem""")
def values_sentinels(spark, d):
    rows = lines(spark, d)
    layer = NumericLayer("l_discount", missing_at_or_below=0.02)
    tax = sentinel(F.col("l_tax"), (0.05,))
    return rows.select(*ORDER, F.when(~tax, layer.parsed(rows)).alias("discount"), layer.present(rows).alias("claims"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS v, l_quantity AS grouped, l_linestatus = 'F' AS yes FROM lineitem")
def values_numeric_text(spark, d):
    """Numbers written with a decimal comma and thousands points are read back."""
    rows = lines(spark, d)
    own = rows.select(*ORDER, F.regexp_replace(F.format_string("%.2f", "l_quantity"), r"\.", ",").alias("a"), F.concat(F.lit("0.0"), F.format_string("%.0f", "l_quantity")).alias("b"), F.when(F.col("l_linestatus") == "F", "True").otherwise("False").alias("c"))
    comma = Notation(",", (".",))
    return own.select(*ORDER, as_number(F.col("a"), own.schema["a"].dataType, comma).alias("v"), as_number(F.col("b"), own.schema["b"].dataType, comma).alias("grouped"), (as_number(F.col("c"), own.schema["c"].dataType) == 1).alias("yes"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v, event_id % 2 = 0 AS even, event_id AS n FROM events")
def values_coercers(spark, d):
    rows = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "NA").otherwise(F.col("value").cast("string")).alias("v"), F.when(F.col("event_id") % 2 == 0, "TRUE").otherwise("0.0").alias("b"), F.concat(F.col("event_id").cast("string"), F.lit(".0")).alias("n"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select("event_id", to_double(drop_tokens(F.col("v"), ("NA",)), kinds["v"]).alias("v"), to_boolean(F.col("b")).alias("even"), to_long(F.col("n"), kinds["n"]).alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer")
def values_normalize(spark, d):
    """Blank text and NaN become null; rows without anything leave."""
    rows = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 5 == 0, float("nan")).otherwise(F.col("c_acctbal")).alias("bal"))
    return normalize_missing(rows)


@query("SELECT n_name, n_regionkey + 100 AS code FROM nation")
def values_remap(spark, d):
    return t(spark, d, "nation").select("n_name", remap_strict(F.col("n_regionkey"), {i: i + 100 for i in range(5)}, "int").alias("code"))


@query("SELECT count(*) FILTER (event_type NOT IN ('click', 'view')) AS n, count(DISTINCT event_type) FILTER (event_type NOT IN ('click', 'view')) AS n_distinct, (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT DISTINCT event_type AS e FROM events WHERE event_type NOT IN ('click', 'view') ORDER BY e LIMIT 5)) AS examples FROM events")
def values_unreadable(spark, d):
    """Tokens that a layer can't read: count, distinct, five sorted examples."""
    rows = t(spark, d, "events")
    layer = FactorLayer("event_type", (("click", 0), ("view", 1)))
    token = F.when(layer.unreadable(rows), F.col("event_type"))
    return rows.agg(F.count(token).alias("n"), F.count_distinct(token).alias("n_distinct"), F.array_join(F.slice(F.array_sort(F.collect_set(token)), 1, 5), ",").alias("examples"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS price FROM orders")
def values_strict_tokens(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, " - ").otherwise(F.col("o_totalprice").cast("string")).alias("p"))
    return rows.select("o_orderkey", strict_number(F.col("p"), ("-",)).alias("price"))


# ----------------------------------------------------------------- columns
@query("""SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_brand END, p_type) AS first_of, CASE WHEN p_size > 25 THEN p_brand || '|' ELSE '' END || p_type AS joined,
 p_type || '/' || p_size AS ion, p_type || '/' || p_size || '/frag_1' AS fragment, replace(replace(p_name, ' ', ';'), ',', ';') AS list FROM part""")
def columns_computed(spark, d):
    rows = t(spark, d, "part")
    brand = F.when(F.col("p_size") > 25, F.col("p_brand"))
    ion = text.proforma_ion(F.col("p_type"), F.col("p_size"))
    return rows.select("p_partkey", text.coalesce_text(brand, F.col("p_type")).alias("first_of"), text.join_nonempty("|", brand, F.col("p_type")).alias("joined"), ion.alias("ion"), text.proforma_fragment(ion, text.positional_label(F.lit(1))).alias("fragment"), text.protein_list(F.col("p_name"), " ").alias("list"))


@query("SELECT p_partkey, p_brand = 'Brand#11' AS eq, starts_with(p_type, 'P') AS pre, len(list_filter(string_split(p_type, ' '), lambda x: starts_with(x, 'B'))) > 0 AS any_of FROM part")
def columns_markers(spark, d):
    return t(spark, d, "part").select("p_partkey", text.marker(F.col("p_brand"), equals="Brand#11").alias("eq"), text.marker(F.col("p_type"), prefix="P").alias("pre"), text.marker(F.col("p_type"), prefix="B", separator=" ").alias("any_of"))


@query("SELECT page_id, regexp_replace(regexp_replace(url || '.mzML.gz', '^.*[/\\\\]', ''), '(?i)\\.(mzml\\.gz|mzml|raw|mgf|d|wiff)$', '') AS base FROM pages")
def columns_basename(spark, d):
    return t(spark, d, "pages").select("page_id", text.ms_basename(F.concat("url", F.lit(".mzML.gz"))).alias("base"))


@query("SELECT p_partkey, upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) AS bare FROM part")
def columns_plain_sequence(spark, d):
    """Strip end marks and inline tokens, leave residues."""
    rows = t(spark, d, "part").select("p_partkey", F.concat(F.lit("_"), F.upper(F.regexp_replace("p_type", "[^A-Za-z]", "")), F.lit("(ox)_")).alias("s"))
    return rows.select("p_partkey", text.strip_tokens(F.col("s"), r"\([^()]*\)").alias("bare"))


@query("SELECT p_partkey, '[UNIMOD:1]-' || upper(regexp_replace(p_brand, '[^A-Za-z]', '', 'g')) || '[UNIMOD:35]' AS form FROM part")
def columns_proforma(spark, d):
    """Modified sequences in ProForma, once for each distinct input."""
    rows = t(spark, d, "part").select("p_partkey", F.concat(F.lit("_(ac)"), F.upper(F.regexp_replace("p_brand", "[^A-Za-z]", "")), F.lit("(ox)_")).alias("s"))
    known = sequences.Tokens((sequences.Modification("ox", "UNIMOD:35"), sequences.Modification("ac", "UNIMOD:1", position="N-term")), False)
    out, _ = sequences.with_sequences(rows, ["s"], "form", sequences.from_tokens(known, r"^\((?P<nterm>[^()]*)\)|\((?P<residue>[^()]*)\)"))
    return out.select("p_partkey", "form")


def _brand(spark, d):
    """Parts with the letters of their brand as a sequence, and a place in it by size."""
    letters = F.upper(F.regexp_replace("p_brand", "[^A-Za-z]", ""))
    return t(spark, d, "part").select("p_partkey", letters.alias("s"), (F.col("p_size") % F.length(letters) + 1).alias("at"))


_BRAND = "(SELECT p_partkey, upper(regexp_replace(p_brand, '[^A-Za-z]', '', 'g')) AS s, p_size % length(upper(regexp_replace(p_brand, '[^A-Za-z]', '', 'g'))) + 1 AS place FROM part)"
_OX = sequences.Tokens((sequences.Modification("ox", "UNIMOD:35"), sequences.Modification("ac", "UNIMOD:1", position="N-term")), False)


@query(f"SELECT p_partkey, s AS bare FROM {_BRAND}")
def columns_bare_sequence(spark, d):
    """A plain sequence without its end marks."""
    return _brand(spark, d).select("p_partkey", text.plain_sequence(F.concat(F.lit("_"), F.col("s"), F.lit("_"))).alias("bare"))


@query(f"SELECT p_partkey, '[UNIMOD:1]-' || substr(s, 1, place::INT) || '[UNIMOD:35]' || substr(s, place::INT + 1) AS form FROM {_BRAND}")
def sequences_site_list(spark, d):
    """Names and sites in parallel lists; site 0 is the N-terminus."""
    rows = _brand(spark, d).select("p_partkey", "s", F.lit("ac;OX").alias("names"), F.concat(F.lit("0;"), F.col("at").cast("string")).alias("sites"))
    out, _ = sequences.with_sequences(rows, ["s", "names", "sites"], "form", sequences.from_site_lists(_OX))
    return out.select("p_partkey", "form")


@query(f"SELECT p_partkey, substr(s, 1, place::INT) || '[UNIMOD:35]' || substr(s, place::INT + 1) AS form FROM {_BRAND}")
def sequences_embedded_sites(spark, d):
    """Entries such as ``ox (R2)``, checked against the sequence."""
    rows = _brand(spark, d).select("p_partkey", "s", F.concat(F.lit("ox ("), F.substring("s", F.col("at").cast("int"), F.lit(1)), F.col("at").cast("string"), F.lit(")")).alias("entries"))
    out, _ = sequences.with_sequences(rows, ["s", "entries"], "form", sequences.from_embedded_sites(_OX, ",", r"(?P<token>\w+) \((?P<site>[^)]*)\)"))
    return out.select("p_partkey", "form")


@query(f"SELECT p_partkey, s AS form FROM {_BRAND}")
def sequences_unknown_dropped(spark, d):
    """The policy ``drop`` leaves tokens out that the map does not know."""
    rows = _brand(spark, d).select("p_partkey", F.concat(F.substring("s", F.lit(1), F.col("at").cast("int")), F.lit("(odd)"), F.expr("substr(s, cast(at as int) + 1)")).alias("s"))
    out, _ = sequences.with_sequences(rows, ["s"], "form", sequences.from_tokens(sequences.Tokens(_OX.entries, False, "drop"), r"\((?P<residue>[^()]*)\)"))
    return out.select("p_partkey", "form")


@query(f"SELECT p_partkey, substr(s, 1, place::INT) || CASE WHEN substr(s, place::INT, 1) IN ('N', 'Q') THEN '[UNIMOD:7]' ELSE '[0.984]' END || substr(s, place::INT + 1) AS form FROM {_BRAND}")
def sequences_by_mass(spark, d):
    """Masses resolve through the table of known modifications, only at the sites it allows."""
    rows = _brand(spark, d).select("p_partkey", F.concat(F.substring("s", F.lit(1), F.col("at").cast("int")), F.lit("(0.984)"), F.expr("substr(s, cast(at as int) + 1)")).alias("s"))
    known = sequences.Tokens(tuple(sequences.Modification(k.name, k.accession, k.mass, k.sites, k.position) for k in TABLE))
    out, _ = sequences.with_sequences(rows, ["s"], "form", sequences.from_tokens(known, r"\((?P<residue>[^()]*)\)"))
    return out.select("p_partkey", "form")


# ------------------------------------------------------------------ checks
@query("SELECT count(*) FILTER (l_tax > 0) / count(*) AS tax, count(*) FILTER (l_discount > 0.05) / count(*) AS discount FROM lineitem")
def checks_occupancy(spark, d):
    rows = lines(spark, d).select(F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("discount"))
    shares = layers.occupancy(rows, ["tax", "discount"])
    return spark.createDataFrame([(shares["tax"], shares["discount"])], "tax double, discount double")


@query("SELECT name, CASE WHEN n = 0 THEN 'empty' ELSE 'single-valued' END AS verdict FROM (SELECT 'empty' AS name, count(nullif(p_size, p_size)) AS n, count(DISTINCT nullif(p_size, p_size)) AS k FROM part UNION ALL SELECT 'one', count(*), count(DISTINCT 'x') FROM part UNION ALL SELECT 'some', count(*) FILTER (p_size > 10), count(DISTINCT CASE WHEN p_size > 10 THEN 'y' ELSE '' END) FROM part UNION ALL SELECT 'p_partkey', count(p_partkey), count(DISTINCT p_partkey) FROM part) WHERE n = 0 OR k = 1")
def checks_uninformative(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.lit("x").alias("one"), F.lit(None).cast("string").alias("empty"), F.when(F.col("p_size") > 10, "y").alias("some"))
    return spark.createDataFrame(sorted(layers.uninformative(rows, ["one", "empty", "some", "p_partkey"]).items()), "name string, verdict string")


@query("SELECT min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max FROM events")
def stats_six_numbers(spark, d):
    out = stats.six_numbers(t(spark, d, "events"), "value")
    return out.select("min", *[F.round(c, 6).alias(c) for c in ("q1", "median", "mean", "q3")], "max")


@query("""SELECT count(*) AS total, count(v) AS finite, count(*) FILTER (v IS NULL) AS nulls, 0::BIGINT AS nans, 0::BIGINT AS pos_inf, 0::BIGINT AS neg_inf, count(*) FILTER (v = 0) AS zeros,
 round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, min(v) AS min, max(v) AS max FROM (SELECT nullif(l_tax, 0.01) AS v FROM lineitem)""")
def stats_layer(spark, d):
    rows = lines(spark, d).select(F.when(F.col("l_tax") != 0.01, F.col("l_tax")).alias("v"))
    return stats.layer_moments(rows, "v").withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))


@query("SELECT l_suppkey AS obs_pos, count(*) AS total, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem WHERE l_suppkey < 100 GROUP BY 1")
def stats_observations(spark, d):
    rows = lines(spark, d).withColumn("obs_pos", F.col("l_suppkey"))
    return stats.observation_moments(rows, "l_quantity").select("obs_pos", "total", F.round("mean", 6).alias("mean"), "min", "max")


@query("""WITH n AS (SELECT count(*) AS n FROM events), g AS (SELECT DISTINCT i * (n - 1) // 499 AS r FROM n, (SELECT unnest(range(0, 500)) AS i)),
v AS (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS r FROM events)
SELECT round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, count(*) AS n_sampled FROM v JOIN g USING (r)""")
def stats_grid_quartiles(spark, d):
    """Quartiles on an even grid over ordered cells (the grid is the feature)."""
    out = stats.grid_quartiles(t(spark, d, "events"), "value", ["event_id"], 500)
    return out.select(*[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "n_sampled")


@query("SELECT count(*) FILTER (label IN (0, 1, 2)) AS known, count(*) FILTER (label NOT IN (0, 1, 2)) AS missing FROM embeddings")
def stats_factor_counts(spark, d):
    return stats.factor_counts(t(spark, d, "embeddings"), "label", [0, 1, 2])


@query("SELECT 0::BIGINT AS o_orderkey, count(*) FILTER (o_orderkey % 3 = 0) AS price FROM orders")
def stats_null_counts(spark, d):
    return stats.null_counts(t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price")))


@query("SELECT c_mktsegment AS source, o_orderpriority AS target, count(*) AS n_edges FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def stats_relation_blocks(spark, d):
    edges = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("source"), F.col("o_orderpriority").alias("target"))
    return stats.relation_blocks(edges)


# ------------------------------------------------------------------- joins
@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def joins_star(spark, d):
    """Chained left joins with a unique right side."""
    out = joins.left_unique(t(spark, d, "orders"), t(spark, d, "customer"), [("o_custkey", "c_custkey")], "customer")
    out = joins.left_unique(out, t(spark, d, "nation"), [("c_nationkey", "n_nationkey")], "nation")
    return joins.left_unique(out, t(spark, d, "region"), [("n_regionkey", "r_regionkey")], "region").select("o_orderkey", "c_name", "n_name", "r_name")


@query("""WITH a AS (SELECT o_custkey AS id, unnest(string_split(string_agg(o_orderkey::VARCHAR, ';'), ';')) AS k FROM orders GROUP BY 1),
b AS (SELECT l_suppkey AS id, unnest(list_distinct(string_split(string_agg(l_orderkey::VARCHAR, ';'), ';'))) AS k FROM lineitem GROUP BY 1)
SELECT DISTINCT a.id::VARCHAR AS _link_cust, b.id::VARCHAR AS _link_supp FROM a FULL JOIN b USING (k)""")
def joins_relationships(spark, d):
    """Id lists exploded, full outer join on the shared id, distinct tuples."""
    a = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(F.collect_list(F.col("o_orderkey").cast("string")), ";").alias("ids"))
    b = lines(spark, d).groupBy(F.col("l_suppkey").alias("id")).agg(F.array_join(F.collect_set(F.col("l_orderkey").cast("string")), ";").alias("ids"))
    return joins.relationships([("cust", joins.exploded_ids(a, {"id": "_link_cust"}, "ids", "k")), ("supp", joins.exploded_ids(b, {"id": "_link_supp"}, "ids", "k"))], "k")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def joins_semi(spark, d):
    rows, f = lines(spark, d), t(spark, d, "orders").filter("o_orderstatus = 'F'")
    return rows.join(f, joins.null_safe(rows, f, [("l_orderkey", "o_orderkey")]), "left_semi").select(*ORDER)


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def joins_anti(spark, d):
    rows, f = t(spark, d, "customer"), t(spark, d, "orders").filter("o_orderstatus = 'P'")
    return rows.join(f, joins.null_safe(rows, f, [("c_custkey", "o_custkey")]), "left_anti").select("c_custkey")


@query("SELECT event_id, (event_id // 100) * 100 AS start, event_id % 100 AS local FROM events")
def joins_block_lookup(spark, d):
    """As-of lookup of the block that holds a position."""
    rows = t(spark, d, "events").select("event_id")
    blocks = rows.select(F.expr("event_id div 100 * 100").alias("start")).distinct()
    out = joins.block_lookup(rows, blocks, "event_id", "start")
    return out.select("event_id", "start", (F.col("event_id") - F.col("start")).alias("local"))


@query("SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS \"user\", arg_min(text, turn) FILTER (role = 'assistant') AS assistant FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def joins_spread_factor(spark, d):
    rows = t(spark, d, "conversations").filter(F.col("role").isin("user", "assistant"))
    return joins.spread_factor(rows, ["conv_id"], "role", "text", ["user", "assistant"], "turn")


@query("""WITH r AS (SELECT user_id AS k, event_type AS a, CASE WHEN event_id % 2 = 0 THEN 'e' END AS b, min(event_id) AS o FROM events GROUP BY ALL)
SELECT k, CASE WHEN count(DISTINCT a) + (count(a) < count(*))::INT = 1 THEN min(a) ELSE string_agg(coalesce(a, 'null'), '|' ORDER BY o) END AS a,
 CASE WHEN count(DISTINCT b) + (count(b) < count(*))::INT = 1 THEN min(b) ELSE string_agg(coalesce(b, 'null'), '|' ORDER BY o) END AS b FROM r GROUP BY k""")
def joins_fold_rows(spark, d):
    """Rows of a key folded: one value if equal, else all in order, missing as ``null``."""
    rows = t(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("a"), F.when(F.col("event_id") % 2 == 0, "e").alias("b"), "event_id")
    return joins.fold_rows(rows, ["k"], ["a", "b"], "event_id")


@query("SELECT l_partkey AS hash, 'R' AS run, round(sum(l_quantity) FILTER (l_returnflag = 'R'), 6) AS intensity, any_value(p_name) AS sequence FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 UNION ALL SELECT l_partkey, 'N', round(sum(l_quantity) FILTER (l_returnflag = 'N'), 6), any_value(p_name) FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def prepare_matrix(spark, d):
    """A wide matrix with feature metadata and per-run values."""
    sums = lines(spark, d).groupBy(F.col("l_partkey").cast("string").alias("mod_seq_charge_hash")).pivot("l_returnflag", ["R", "N"]).agg(F.round(F.sum("l_quantity"), 6))
    meta = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("mod_seq_charge_hash"), F.col("p_name").alias("sequence"), F.explode(F.array(F.lit("R"), F.lit("N"))).alias("run"), F.lit(0.0).alias("qval"))
    out = prepare.join_matrix_metadata({"matrix": sums, "precursors": meta})
    return out.select(F.col("mod_seq_charge_hash").cast("long").alias("hash"), "run", "intensity", "sequence")


@query("SELECT event_id, event_type FROM events WHERE NOT contains(event_type, 'e')")
def prepare_drop_containing(spark, d):
    rows, _ = prepare.drop_containing(t(spark, d, "events").select("event_id", "event_type"), "event_type", "e")
    return rows


@query("SELECT n_name AS \"nation.n_name\", n_regionkey AS \"nation.n_regionkey\" FROM nation")
def prepare_prefix(spark, d):
    return prepare.prefixed(t(spark, d, "nation").select("n_name", "n_regionkey"), "nation")


@query("SELECT c_custkey AS id, ids FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT n_regionkey AS region, string_agg(n_name, ';' ORDER BY n_name) AS ids FROM nation GROUP BY 1) ON region = n_regionkey")
def prepare_razor(spark, d):
    """Rows with the members of that of their groups which holds their leading member."""
    nation = t(spark, d, "nation")
    groups = nation.groupBy(F.col("n_regionkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ";").alias("Protein IDs"))
    every = F.lit(";".join(str(r["id"]) for r in groups.select("id").orderBy("id").collect()))  # five regions
    rows = t(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("Leading razor protein"), every.alias("Protein group IDs"))
    out = prepare.join_razor_groups({"evidence": rows, "protein": groups})
    return out.select(q("evidence.id").alias("id"), q("protein.Protein IDs").alias("ids"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def prepare_protein_sets(spark, d):
    """Rows with the columns of the one set they name."""
    ions = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("protein_set_id"))
    sets = t(spark, d, "customer").select(F.col("c_custkey").alias("protein_set_id"), "c_name")
    out = prepare.join_protein_sets({"peptidoform_ion": ions, "protein": sets})
    return out.select(q("peptidoform_ion.o_orderkey").alias("o_orderkey"), q("protein.c_name").alias("c_name"))


@query("SELECT event_id, event_type FROM events WHERE contains(event_type, 'i') AND value >= 10")
def prepare_equality(spark, d):
    """Rows whose two marks have one value each."""
    rows = t(spark, d, "events").select("event_id", "event_type", F.when(F.contains("event_type", F.lit("i")), 1).otherwise(2).alias("Full Sequences Mapped"), F.initcap((F.coalesce(F.col("value") < 10, F.lit(True))).cast("string")).alias("Random RT"))
    return prepare.single_mapped_peaks({"peaks": rows}).select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events WHERE NOT contains(event_type, 'i')")
def prepare_unambiguous(spark, d):
    """Rows whose name holds no mark of ambiguity."""
    return prepare.unambiguous_peptides({"peptides": t(spark, d, "events").select("event_id", "event_type")}, "event_type", "i")


# ---------------------------------------------------------------- reshaping
@query("SELECT l_partkey AS var_pos, l_linenumber::BIGINT AS obs_pos, round(sum(l_quantity), 6) AS value FROM lineitem GROUP BY ALL HAVING round(sum(l_quantity), 6) <> 10")
def reshape_sparse(spark, d):
    """A dense table to its cells that differ from a fill."""
    sums = lines(spark, d).groupBy(F.col("l_partkey").alias("var_pos")).pivot("l_linenumber", list(range(1, 8))).agg(F.round(F.sum("l_quantity"), 6))
    return reshape.to_sparse(sums, "var_pos", {str(i): i for i in range(1, 8)}, fill=10.0)


@query("SELECT p_partkey AS var_pos, " + ", ".join(f'coalesce(round(sum(l_quantity) FILTER (l_linenumber = {i}), 6), -1) AS "{i}"' for i in range(1, 8)) + " FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def reshape_dense(spark, d):
    cells_ = lines(spark, d).groupBy(F.col("l_partkey").alias("var_pos"), F.col("l_linenumber").alias("obs_pos")).agg(F.round(F.sum("l_quantity"), 6).alias("value"))
    return reshape.to_dense(cells_, t(spark, d, "part").select(F.col("p_partkey").alias("var_pos")), "var_pos", list(range(1, 8)), fill=-1.0)


@query("SELECT 'part' AS source, l_partkey AS \"row\", 'supplier' AS target, l_suppkey AS \"column\", count(*)::DOUBLE AS value FROM lineitem GROUP BY ALL")
def reshape_relations(spark, d):
    """Edges to one global grid and back by offsets."""
    edges = lines(spark, d).groupBy(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("column")).agg(F.count("*").cast("double").alias("value")).select(F.lit("part").alias("source"), "row", F.lit("supplier").alias("target"), "column", "value")
    sizes = spark.createDataFrame([("part", 0, 10_000_000), ("supplier", 1, 10_000_000)], "level string, order int, size long")
    offsets = reshape.level_offsets(sizes)
    return reshape.to_levels(reshape.to_global(edges, offsets), offsets)


@query("SELECT event_id, to_json([user_id::VARCHAR, event_type])::VARCHAR AS label, (props->>'$.k')::BIGINT AS k FROM events")
def reshape_labels(spark, d):
    """Several keys as one stored label, and typed values of embedded JSON."""
    return t(spark, d, "events").select("event_id", reshape.json_label(F.col("user_id"), F.col("event_type")).alias("label"), reshape.embedded_json(F.col("props"), "k long")["k"].alias("k"))


@query("SELECT event_type, count(*) AS n_keys, sum(n)::BIGINT AS n_rows, max(k) <= 1 AS placeable FROM (SELECT user_id, event_type, count(*) AS n, count(DISTINCT value) AS k FROM events GROUP BY ALL) GROUP BY event_type")
def reshape_placeable(spark, d):
    return reshape.placeable_factors(t(spark, d, "events"), "user_id", "event_type", "value").select("event_type", "n_keys", "n_rows", "placeable")


@query("SELECT conv_id, turn, role, length(text) AS n, lang FROM conversations LEFT JOIN (SELECT doc_id AS conv_id, lang FROM documents) USING (conv_id)")
def reshape_samples(spark, d):
    """Rows joined with a bounded sample table."""
    samples = t(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), "lang")
    return reshape.with_samples(t(spark, d, "conversations"), samples, "conv_id").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"), "lang")


# --------------------------------------------------- alignment and annotation
def _obs(spark, d):
    from quantloom.result import Level

    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("run"), F.col("doc_id").alias("obs_pos"))
    cells_ = t(spark, d, "documents").select(F.lit(0).cast("long").alias("var_pos"), F.col("doc_id").alias("obs_pos"), F.col("n_chars").cast("double").alias("n"))
    var = spark.createDataFrame([("chars", 0)], "feature string, var_pos long")
    from quantloom.result import LayerInfo

    return Level("protein", docs, var, cells_, ("run",), ("feature",), {"n": LayerInfo("n")}, "n")


def _labels(spark, d):
    return t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("run"), "quality", "toxic")


@query("SELECT documents.doc_id::VARCHAR AS run, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def annotate_keep(spark, d):
    out, _ = annotate.annotate(_obs(spark, d), _labels(spark, d), unmatched="keep")
    return out.obs.select("run", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))


@query("SELECT documents.doc_id::VARCHAR AS run, quality, toxic, row_number() OVER (ORDER BY documents.doc_id) - 1 AS obs_pos, n_chars::DOUBLE AS n FROM documents JOIN labels USING (doc_id)")
def annotate_drop(spark, d):
    """Matched observations only, renumbered, with their cells."""
    out, _ = annotate.annotate(_obs(spark, d), _labels(spark, d), unmatched="drop")
    return out.obs.join(out.cells, "obs_pos").select("run", "quality", "toxic", "obs_pos", "n")


@query("SELECT doc_id::VARCHAR AS run, lang IS NULL AS missing FROM documents")
def annotate_error(spark, d):
    table = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("run"), "lang")
    out, _ = annotate.annotate(_obs(spark, d), table, unmatched="error")
    return out.obs.select("run", F.col("lang").isNull().alias("missing"))


@query("SELECT count(*) AS matched, (SELECT count(*) FROM documents) - count(*) AS only_observations, 0::BIGINT AS only_annotation FROM labels JOIN documents USING (doc_id)")
def annotate_coverage(spark, d):
    _, seen = annotate.annotate(_obs(spark, d), _labels(spark, d))
    return spark.createDataFrame([(seen.matched, seen.only_observations, seen.only_annotation)], "matched long, only_observations long, only_annotation long")


@query("SELECT 'customer ' || upper(n_name) AS observed, n_name AS expected FROM nation")
def annotate_fuzzy(spark, d):
    """Mutual best names under a cutoff and a margin."""
    own = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("obs_pos"), F.concat(F.lit("customer "), F.upper("n_name")).alias("observed"), "n_name")
    table = own.select("n_name", F.col("obs_pos").alias("_row"))
    pairs, _ = annotate.match_fuzzy(own.select("obs_pos", "observed"), "observed", table, "n_name", 0.3, 0.0)
    return pairs.join(own.select("obs_pos", "observed"), "obs_pos").join(table, "_row").select("observed", F.col("n_name").alias("expected"))


@query("SELECT k, row_number() OVER (ORDER BY o) - 1 AS pos FROM (SELECT k, min(o) AS o FROM (SELECT s_suppkey AS k, 1000000 + s_suppkey AS o FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 2000000 + s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY k)")
def align_spine(spark, d):
    """Ordered union of two levels' observations."""
    from quantloom.result import Level

    def level(n):
        obs = axis.positions(t(spark, d, "supplier").filter(f"s_suppkey % {n} = 0").select(F.col("s_suppkey").alias("k")), "k", "obs_pos")
        return Level("protein", obs, obs, obs, ("k",), ("k",), {})

    return align.spine([level(2), level(3)]).select("k", F.col("_new").alias("pos"))


@query("SELECT (SELECT count(*) = count(DISTINCT n_name) FROM nation) AS names, (SELECT count(*) = count(DISTINCT n_regionkey) FROM nation) AS regions")
def align_bijection(spark, d):
    own = t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return spark.createDataFrame([(align.is_bijection(own, ["n_nationkey"], ["n_name"]), align.is_bijection(own, ["n_nationkey"], ["n_regionkey"]))], "names boolean, regions boolean")


# --------------------------------------------------------- whole conversions
_RULE = {
    "software_name": "lines", "software_version_pattern": ".", "hierarchy": "lfq",
    "tables": [{"input": {"shape": "long", "extensions": [".parquet"]}, "levels": {"protein": {
        "axis": {"obs_keys": ["supplier"], "var_keys": ["part"]},
        "measurements": {"primary_layer": "quantity", "repeated_cells": {"mode": "sum"}, "layers": [{"name": "quantity", "source": "l_quantity"}, {"name": "price", "source": "l_extendedprice"}]},
        "columns": {"obs": [{"name": "supplier", "source": "l_suppkey"}], "var": [{"name": "part", "source": "l_partkey"}, {"name": "flagged", "how": "decoy", "inputs": ["part"], "prefix": "1"}]},
    }}}],
}


@query("""WITH v AS (SELECT l_partkey::VARCHAR AS part FROM lineitem GROUP BY 1)
SELECT l_partkey::VARCHAR AS part, l_suppkey::VARCHAR AS supplier, starts_with(l_partkey::VARCHAR, '1') AS flagged, round(sum(l_quantity), 6) AS quantity, round(sum(l_extendedprice), 6) AS price FROM lineitem GROUP BY 1, 2, 3""")
def convert_rule(spark, d):
    """A rule document from header to axes and sparse layers."""
    from quantloom.plans.execute import execute
    from quantloom.plans.resolve import resolve
    from quantloom.plans.rules import Document

    rows = lines(spark, d).select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "_ord")
    plan = resolve(Document(_RULE).rule("protein"), tuple(c for c in rows.columns if c != "_ord"))
    level = execute(plan, rows, staged=False)
    out = level.cells.join(level.var, "var_pos").join(level.obs, "obs_pos")
    return out.select("part", "supplier", "flagged", F.round("quantity", 6).alias("quantity"), F.round("price", 6).alias("price"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


