"""Operators on small frames: nulls, NaN, blanks, ties, repeats, and every refusal."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quantloom.errors import (
    AggregateTypeError, AmbiguousDialectError, DuplicateCellError, IncompatibleSourceError, InputPreparationError, LayerContractError, LayerValueError,
    MzTabFormatError, PackedLengthError, PackedSiteMismatchError, UnknownModificationError, UnplaceableModificationError, UnrecognizedSequenceCharacterError,
)
from quantloom.functions import sequences, text
from quantloom.functions.values import Notation, as_number, encode_factor, normalize_missing, to_boolean, to_double, to_long
from quantloom.operators import annotate, axis, cells, joins, layers, layout, prepare, stats
from quantloom.operators.axis import Policy
from quantloom.operators.cells import CellPolicy
from quantloom.operators.layers import FactorLayer, NumericLayer
from quantloom.sources import binding, delimited, mztab, workbook
from quantloom.sources.delimited import Dialects


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}")


@pytest.mark.parametrize("value,number", [("1.5", 1.5), ("1.5d", None), ("1f", None), ("True", 1.0), ("false", 0.0), ("", None), ("x", None), (".5e1", 5.0), (None, None)])
def test_numbers(spark, value, number):
    df = one(spark, value)
    assert df.select(as_number(F.col("v"), df.schema["v"].dataType)).first()[0] == number


def test_number_notation_and_coercers(spark):
    df = one(spark, "1.234,5")
    assert df.select(as_number(F.col("v"), df.schema["v"].dataType, Notation(",", (".",)))).first()[0] == 1234.5
    for value, fit in (("7.0", 7), ("7.5", None), ("9223372036854775807", 9223372036854775807), ("inf", None)):
        df = one(spark, value)
        assert df.select(to_long(F.col("v"), df.schema["v"].dataType)).first()[0] == fit
    df = one(spark, "inf")
    assert df.select(to_double(F.col("v"), df.schema["v"].dataType)).first()[0] is None
    assert [one(spark, v).select(to_boolean(F.col("v"))).first()[0] for v in ("TRUE", "0.0", "yes")] == [True, False, None]
    assert [one(spark, v).select(encode_factor(F.col("v"), {"a": 3})).first()[0] for v in ("a", "b", None)] == [3, -1, -1]


def test_missing(spark):
    df = spark.createDataFrame([("a", 1.0), (" ", float("nan")), (None, 2.0)], "t string, x double")
    assert rows(normalize_missing(df)) == [("a", 1.0), (None, 2.0)]


def test_axis_policies_follow_row_order(spark):
    data = [("k", "b", "10", 1.0, 3), ("k", "a", "9", None, 1), ("k", None, "x", 5.0, 2), (None, "z", "1", float("nan"), 4), ("j", None, None, 1.0, 5), ("j", "q", None, 1.0, 6)]
    random.Random(3).shuffle(data)
    df = spark.createDataFrame(data, "key string, g string, n string, s double, o int")
    out = axis.build_features(df, ["key"], {"g": Policy("first"), "n": Policy("min"), "s": Policy("max")}, "o")
    assert rows(out.select("key", "g", "g?", "n", "s")) == [("j", "q", False, None, 1.0), ("k", "a", True, "9", 5.0), (None, "z", False, "1", None)]
    best = axis.build_features(df, ["key"], {"g": Policy("best_row", "s", "highest")}, "o")
    assert rows(best.select("key", "g")) == [("j", None), ("k", None), (None, "z")]
    assert rows(axis.disagreements(df, ["key"], "g", "o")) == [("k", 2, ["a", "b"])]
    assert rows(axis.best_rows(df, ["key"], "s", "lowest", "o").select("o")) == [(3,), (4,), (5,)]
    assert rows(axis.build_axis(df, ["key"], ["g"], "o")) == [("j", None, 5), ("k", "a", 1), (None, "z", 4)]
    with pytest.raises(AggregateTypeError):
        axis.require_numeric(df, "n")
    assert [r["pos"] for r in axis.positions(df.select("o"), "o", "pos").orderBy("o").collect()] == list(range(6))


def test_cells(spark):
    df = spark.createDataFrame([("f", "a", 1.0, 0.5, 1), ("f", "a", 3.0, 0.1, 2), ("f", "b", None, 0.2, 3), ("f", "b", None, None, 4)], "v string, o string, x double, pep double, r int")
    cell = ["v", "o"]
    with pytest.raises(DuplicateCellError):
        cells.resolve(df, cell, ["x"], CellPolicy("error"), "r")
    with pytest.raises(DuplicateCellError):
        cells.resolve(df, cell, ["x"], CellPolicy("same"), "r")
    assert rows(cells.resolve(df, cell, ["x"], CellPolicy("sum"), "r").select("o", "x")) == [("a", 4.0), ("b", None)]
    assert rows(cells.resolve(df, cell, ["x", "pep"], CellPolicy("keep_best", "pep", "lowest", ("x",)), "r").select("o", "x", "pep")) == [("a", 4.0, 0.1), ("b", None, 0.2)]
    same = spark.createDataFrame([("f", "a", None, 1), ("f", "a", 2.0, 2), ("f", "a", 2.0, 3)], "v string, o string, x double, r int")
    assert rows(cells.resolve(same, cell, ["x"], CellPolicy("same"), "r").select("x")) == [(2.0,)]
    assert rows(cells.resolve(df.limit(0), cell, ["x"], CellPolicy("sum"), "r")) == []


def test_layers(spark):
    df = spark.createDataFrame([("1",), ("0",), ("-",), ("zz",), (None,), ("2.5",)], "x string")
    layer = NumericLayer("x", missing_at_or_below=0, missing_tokens=("-",))
    assert [r[0] for r in layers.parse_layers(df, [layer]).collect()] == [1.0, None, None, None, None, 2.5]
    assert [r[0] for r in df.select(layer.present(df)).collect()] == [True, False, False, True, False, True]
    assert layers.diagnose(df, [layer]) == {"x": {"count": 1, "distinct": 1, "examples": ["zz"]}}
    with pytest.raises(LayerValueError):
        layers.diagnose(df, [NumericLayer("x", "integer")])
    assert layers.diagnose(df, [FactorLayer("x", (("1", 1), ("0", 0), ("-", 2)))])["x"]["examples"] == ["2.5", "zz"]
    assert layers.require_filled({"a": 1.0, "b": 0.0, "c": 0.5}, "a") == ["b"]
    with pytest.raises(LayerContractError):
        layers.require_filled({"a": 0.0, "b": 0.9}, "a")
    odd = spark.createDataFrame([(1, None, "s", 1), (2, None, "s", None)], "k int, e string, s string, p int")
    assert layers.uninformative(odd, ["k", "e", "s", "p"]) == {"e": "empty", "s": "single-valued"}


def test_packed(spark):
    df = spark.createDataFrame([("p", " 10 ; 20 ;", "b3/x;y1", 1), ("q", "1;;3", "a;b;c", 2), ("r", None, None, 3)], "k string, v string, l string, o int")
    layout.require_parallel(df, {"v": ";", "l": ";"}, ["k"])
    out = layout.packed_facts(df, ["k"], {"x": "v"}, ";", "o", labels_from="l")
    assert rows(out.select("k", "label", "x")) == [("p", "b3", "10"), ("p", "y1", "20"), ("q", "a", "1"), ("q", "b", None), ("q", "c", "3"), ("r", None, None)]
    with pytest.raises(PackedLengthError):
        layout.require_parallel(df.withColumn("l", F.lit("a")), {"v": ";", "l": ";"}, ["k"])


def test_wide_samples(spark):
    assert layout.match_samples(["id", "I a", "I b", "J a"], {"i": "^I (?P<sample>.+)$", "j": "^J (?P<sample>.+)$"}, {"id"}) == {"a": {"i": "I a", "j": "J a"}, "b": {"i": "I b"}}
    with pytest.raises(IncompatibleSourceError):
        layout.match_samples(["I a", "i a"], {"i": "^[Ii] (?P<sample>.+)$"})


TOKENS = sequences.Tokens((sequences.Modification("ox", "U:35", 15.9949), sequences.Modification("ac", "U:1", position="N-term"), sequences.Modification("p", "U:21", targets=("S", "T"))), False)
INLINE = r"^\((?P<nterm>[^()]*)\)|\((?P<residue>[^()]*)\)"


def test_sequences():
    run = sequences.from_tokens(TOKENS, INLINE)
    assert run("_(ac)PEM(OX)K_") == ("[U:1]-PEM[U:35]K", [])
    assert run("PEM(+15.995)K")[0] == "PEM[U:35]K"
    assert run("S(p)A(p)") == ("S[U:21]A[p]", ["p"])
    with pytest.raises(UnplaceableModificationError):
        sequences.from_tokens(TOKENS, r"\((?P<residue>[^()]*)\)")("(ox)PEP")
    with pytest.raises(UnrecognizedSequenceCharacterError):
        run("PE|P")
    with pytest.raises(UnknownModificationError):
        sequences.from_tokens(sequences.Tokens((), True, "error"), INLINE)("P(zz)")
    sites = sequences.from_site_lists(TOKENS)
    assert sites("PEM", "ac;ox", "0;3")[0] == "[U:1]-PEM[U:35]"
    assert sites("PEM", "ox", "9")[0] == "PEM-[U:35]"
    with pytest.raises(PackedSiteMismatchError):
        sites("PEM", "ox;ox", "1")
    named = sequences.Tokens((sequences.Modification("Oxidation", "U:35"),))
    inside = sequences.from_embedded_sites(named, ",", r"(?:(?P<count>\d+) )?(?P<token>\w+) \((?P<site>[^)]*)\)", unlocalized=True)
    assert inside("PEMM", "Oxidation (M3)")[0] == "PEM[U:35]M"
    assert inside("PEMM", "2 Oxidation (M)")[0] == "[U:35][U:35]?PEMM"
    with pytest.raises(PackedSiteMismatchError):
        inside("PEMM", "Oxidation (P3)")


def test_map_resolution_by_site_and_mass():
    from quantloom.functions.unimod import TABLE, unimod

    book = sequences.Tokens(tuple(sequences.Modification(k.name, k.accession, k.mass, k.sites, k.position) for k in TABLE))
    run = sequences.from_tokens(book, INLINE)
    # an oxidation sits on M alone, a phosphate on S, T and Y, a pyroglutamate on an N-terminal E
    assert run("PEM(Oxidation)K") == ("PEM[UNIMOD:35]K", []) and run("PEK(Oxidation)K") == ("PEK[Oxidation]K", ["Oxidation"])
    assert run("S(79.966)T(79.966)A(79.966)")[0] == "S[UNIMOD:21]T[UNIMOD:21]A[79.966]"
    assert run("(Glu->pyro-Glu)EK")[0] == "[UNIMOD:27]-EK" and run("(Glu->pyro-Glu)QK")[1] == ["Glu->pyro-Glu"]
    assert run("(-17.0265)QK")[0] == "[UNIMOD:28]-QK" and run("(Acetyl)AK")[0] == "[UNIMOD:1]-AK" and run("A(Acetyl)K")[1] == ["Acetyl"]
    assert unimod("57.0215").accession == "UNIMOD:4" and unimod("gg").sites == ("K",) and unimod("nothing") is None and unimod("57.03") is None
    first = sequences.Tokens((sequences.Modification("x", "U:1", 10.0, ("K",)), sequences.Modification("x", "U:2", 10.0005)))
    assert sequences.from_tokens(first, INLINE)("K(x)A(x)K(10.0003)A(10.0003)")[0] == "K[U:1]A[U:2]K[U:1]A[U:2]"
    assert sequences.from_tokens(sequences.Tokens((), True, "drop"), INLINE)("P(zz)") == ("P", [])


def test_six_numbers_with_hot_values(spark):
    import numpy as np

    values = [3.0] * 500 + [float(i) for i in range(7)] + [None, float("nan"), float("inf")]
    got = stats.six_numbers(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    x = np.array([v for v in values if v is not None and np.isfinite(v)])
    assert np.allclose(tuple(got), [x.min(), *np.quantile(x, [0.25, 0.5]), x.mean(), np.quantile(x, 0.75), x.max()])
    few = stats.six_numbers(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "v double"), "v").first()
    assert tuple(few) == (1.0, 1.75, 3.0, 3.75, 5.0, 8.0)
    assert tuple(stats.six_numbers(spark.createDataFrame([], "v double"), "v").first()) == (None,) * 6


def test_sequence_column(spark):
    df = spark.createDataFrame([("P(ox)",), ("P(ox)",), (None,), ("A(q)",)], "s string")
    out, unknown = sequences.with_sequences(df, ["s"], "f", sequences.from_tokens(TOKENS, INLINE))
    assert rows(out.select("f")) == [("A[q]",), ("P[U:35]",), ("P[U:35]",), (None,)] and unknown == ["q"]
    with pytest.raises(UnrecognizedSequenceCharacterError):
        sequences.with_sequences(one(spark, "P|").withColumnRenamed("v", "s"), ["s"], "f", sequences.from_tokens(TOKENS, INLINE))


def test_text(spark):
    df = spark.createDataFrame([("A, B ;C|D", r"x\y/run1.RAW", None)], "p string, f string, n string")
    r = df.select(text.protein_list(F.col("p"), "|"), text.ms_basename(F.col("f")), text.marker(F.col("n"), prefix="x"), text.join_nonempty("-", F.col("n"), F.col("n")), text.proforma_ion(F.lit("P"), F.lit(0))).first()
    assert tuple(r) == ("A;B;C;D", "run1", False, None, None)
    assert text.sanitize_name("Größe [µm]") == "Groe__m_"
    assert text.cv_name("[MS, MS:1, name here, ]") == "name here"


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n"), (3, "y")], "k int, t string")
    b = spark.createDataFrame([(1, "one"), (None, "none")], "k2 int, u string")
    assert rows(joins.left_unique(a, b, [("k", "k2")], "b").select("t", "u")) == [("n", "none"), ("x", "one"), ("y", None)]
    with pytest.raises(InputPreparationError):
        joins.left_unique(a, b.union(b), [("k", "k2")], "b")
    with pytest.raises(InputPreparationError):
        joins.require_referenced(a, b, [("k", "k2")], "a")
    pos = spark.createDataFrame([(0,), (4,), (9,), (-1,)], "p int")
    blocks = spark.createDataFrame([(0, "A"), (5, "B")], "start int, name string")
    assert rows(joins.block_lookup(pos, blocks, "p", "start").select("p", "name")) == [(0, "A"), (4, "A"), (9, "B")]
    fold = spark.createDataFrame([(1, "a", None, 1), (1, "a", "z", 2), (1, "a", "z", 3), (2, "b", None, 4)], "k int, s string, t string, o int")
    assert rows(joins.fold_rows(fold, ["k"], ["s", "t"], "o")) == [(1, "a", "null|z"), (2, "b", None)]


def test_linked_exports(spark):
    pep = spark.createDataFrame([("1", "10;11", "P"), ("2", None, "Q")], "id string, `Evidence IDs` string, Sequence string")
    prot = spark.createDataFrame([("7", "11", "A"), ("8", "", "B")], "id string, `Evidence IDs` string, `Protein IDs` string")
    out = prepare.join_linked_exports({"peptide": pep, "protein": prot})
    assert rows(out.select("`peptide.Sequence`", "`protein.Protein IDs`")) == [("P", "A"), ("P", None), ("Q", None), (None, "B")]
    with pytest.raises(InputPreparationError):
        prepare.join_linked_exports({"peptide": pep.union(pep)})
    evidence = spark.createDataFrame([("1", "A1", "7;8")], "id string, `Leading razor protein` string, `Protein group IDs` string")
    groups = spark.createDataFrame([("7", "A1;A2"), ("8", "B")], "id string, `Protein IDs` string")
    assert rows(prepare.join_razor_groups({"evidence": evidence, "protein": groups}).select("`protein.Protein IDs`")) == [("A1;A2",)]
    with pytest.raises(InputPreparationError):
        prepare.join_razor_groups({"evidence": evidence.withColumn("Leading razor protein", F.lit("Z")), "protein": groups})


def test_matrix_and_row_filters(spark):
    big = "18446744073709551615"
    matrix = spark.createDataFrame([(big, 1.0, None)], "mod_seq_charge_hash string, A double, B double")
    meta = spark.createDataFrame([(big, "P", "A", 0.1, 9.0)], "mod_seq_charge_hash string, sequence string, run string, qval double, intensity double")
    assert rows(prepare.join_matrix_metadata({"matrix": matrix, "precursors": meta}).select("run", "intensity", "sequence", "qval")) == [("A", 1.0, "P", 0.1), ("B", None, "P", None)]
    with pytest.raises(InputPreparationError):
        prepare.join_matrix_metadata({"matrix": matrix.withColumn("mod_seq_charge_hash", F.lit("1")), "precursors": meta})
    peaks = spark.createDataFrame([("1", "False", "a"), ("2", "False", "b"), ("1", "True", "c")], "`Full Sequences Mapped` string, `Random RT` string, x string")
    assert rows(prepare.single_mapped_peaks({"peaks": peaks}).select("x")) == [("a",)]
    assert rows(prepare.unambiguous_peptides({"peptides": spark.createDataFrame([("A|B",), ("C",), (None,)], "modified_peptide string")})) == [("C",), (None,)]


def test_statistics(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,), (float("inf"),), (float("nan"),)], "x double")
    assert tuple(stats.six_numbers(df, "x").first()) == (1.0, 1.75, 2.5, 4.0, 4.75, 10.0)
    m = stats.layer_moments(df, "x").first()
    assert (m["total"], m["finite"], m["nulls"], m["nans"], m["pos_inf"], m["max"]) == (7, 4, 1, 1, 1, 10.0)


def test_dialects(spark, tmp_path):
    f = tmp_path / "d.csv"
    f.write_text("a;b\n1,5;x\n")
    both = Dialects((",", ";"), (Notation("."), Notation(",")))
    dialect, header = delimited.resolve(f, both, lambda h: set(h) == {"a", "b"})
    assert (dialect.delimiter, dialect.notation.decimal_mark, header) == (";", ",", ("a", "b"))
    assert rows(delimited.read(spark, f, dialect, header, ["b"]).select("b")) == [("x",)]
    with pytest.raises(IncompatibleSourceError):
        delimited.resolve(f, both, lambda h: "zz" in h)
    with pytest.raises(AmbiguousDialectError):
        delimited.resolve(f, both)
    (tmp_path / "l.csv").write_bytes("ä\n".encode("cp1252"))
    assert delimited.encoding_of(tmp_path / "l.csv", ("utf8", "windows-1252")) == "windows-1252"
    import gzip
    g = tmp_path / "z.tsv.gz"
    g.write_bytes(gzip.compress(b"a\tb\n1\t\n"))
    df, header, _ = binding.read_table(spark, g)
    assert rows(df.select("a", "b")) == [("1", None)]
    with pytest.raises(IncompatibleSourceError):
        binding.claim(g, (".csv",))


def test_workbook(spark, tmp_path):
    workbook.write_sheets(tmp_path / "w.xlsx", {"S": [["a", "b"], ["1", None], ["x<", "y"]], "T": [["q"]]})
    assert workbook.sheet_names(tmp_path / "w.xlsx") == ["S", "T"]
    assert rows(workbook.read_sheet(spark, tmp_path / "w.xlsx", "S").select("a", "b")) == [("1", None), ("x<", "y")]


MZTAB = "MTD\tmzTab-version\t1.0.0\nMTD\tms_run[1]-location\tfile:a\nCOM\thello\nPRH\taccession\tabundance_assay[1]\tabundance_assay[2]\nPRT\tP1\t1\tnull\nPSH\tPSM_ID\tspectra_ref\taccession\nPSM\t1\tms_run[1]:s=1|ms_run[2]:s=3\tP1\nPSM\t1\tms_run[1]:s=1|ms_run[2]:s=3\tP2\n"


def test_mztab(spark, tmp_path):
    (tmp_path / "f.mztab").write_text(MZTAB)
    got = mztab.split(spark, tmp_path / "f.mztab")
    assert got.keys("^ms_run") == [("ms_run[1]-location", "file:a")]
    assert rows(mztab.long_table(got.sections["PRT"], "assay", ["accession"]).drop("line")) == [("P1", "assay[1]", "1"), ("P1", "assay[2]", None)]
    assert rows(mztab.folded(got.sections["PSM"], "PSM").select("accession")) == [("P1|P2",)]
    assert rows(mztab.runs_of(got.sections["PSM"].limit(1)).select("run")) == [("1",), ("2",)]
    assert set(mztab.write_long(got, str(tmp_path / "out"))) == {"PRT_assay", "metadata"}
    for bad in ("XYZ\t1\n", "PRT\t1\nPRH\ta\n", "PRH\ta\nPRH\tb\n", "PRH\ta\nPRT\t1\t2\n", "PRH\ta\ta\n"):
        (tmp_path / "bad").write_text(bad)
        with pytest.raises(MzTabFormatError):
            mztab.split(spark, tmp_path / "bad")
    assert mztab.entity_walk({"assay[1]": {"r": ["ms_run[1]"]}, "study_variable[1]": {"r": ["assay[1]"]}}, ["assay[1]"], frozenset({"study_variable"})) == ["assay[1]", "ms_run[1]"]


def test_streaming(spark, tmp_path):
    from quantloom.streaming import stateless

    spark.createDataFrame([("1", " "), ("x", "b"), (" ", "")], "x string, t string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("x string, t string").parquet(str(tmp_path / "in"))
    parsed = stateless.parse(stateless.clean(source), [NumericLayer("x")])
    run = stateless.per_batch(parsed, lambda b: b, str(tmp_path / "out")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("x", "t")) == [(1.0, None), (None, "b")]


def test_registry_covers_entry():
    import __spark_entry__ as entry

    own, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(own) and len(own) > 50
    json.dumps(sorted(own))


def test_reshaping(spark):
    from quantloom.operators import reshape

    wide = spark.createDataFrame([(0, 1.0, -1.0, None), (1, None, 2.0, 3.0)], "var_pos long, a double, b double, c double")
    cells_ = reshape.to_sparse(wide, "var_pos", {"a": 0, "b": 1, "c": 2}, fill=-1.0)
    assert rows(cells_) == [(0, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0)]
    assert rows(reshape.to_dense(cells_, wide, "var_pos", [0, 1, 2], fill=-1.0)) == [(0, 1.0, -1.0, -1.0), (1, -1.0, 2.0, 3.0)]
    edges = spark.createDataFrame([("x", 1, "y", 0, 1.0)], "source string, row long, target string, column long, value double")
    offsets = reshape.level_offsets(spark.createDataFrame([("x", 0, 5), ("y", 1, 3)], "level string, order int, size long"))
    flat = reshape.to_global(edges, offsets)
    assert rows(flat) == [(1, 5, 1.0)] and rows(reshape.to_levels(flat, offsets)) == rows(edges)
    assert spark.range(1).select(reshape.json_label(F.lit("a"), F.lit(None))).first()[0] == '["a",null]'
    gone = spark.createDataFrame([("k", 2), (None, 3)], "key string, n int")
    assert rows(reshape.surviving(gone, spark.createDataFrame([(None,)], "key string"), ["key"])) == [(None, 3)]
    assert rows(reshape.placeable_factors(spark.createDataFrame([(1, "f", "a"), (1, "f", "a"), (1, "g", "a"), (1, "g", "b")], "k int, f string, v string"), "k", "f", "v")) == [("f", 1, 2, True), ("g", 1, 2, False)]
    with pytest.raises(InputPreparationError):
        reshape.require_square(spark.createDataFrame([(0, 9)], "var_pos long, obs_pos long"), 2, 2)


def brute_fuzzy(left, right, cutoff, margin):
    """Mutual best pairs, from every score."""
    score = {(o, r): annotate.similarity(a or "", b or "") for o, a in left for r, b in right}
    found = set()
    for (o, r), s in score.items():
        own, other = ([(-x, k) for k, x in score.items() if k[i] == v] for i, v in ((0, o), (1, r)))
        clear = lambda side: s - max([-x for x, k in side if k != (o, r)], default=0.0) >= margin
        if s >= cutoff and min(own)[1] == (o, r) == min(other)[1] and clear(own) and clear(other):
            found.add((o, r))
    near = {(o, r) for o, _ in left if o not in {x for x, _ in found} for _, r in sorted((-score[o, r], r) for r, _ in right)[:3]}
    return found, near


@pytest.mark.parametrize("block", [1, 4, 512])
def test_fuzzy_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(annotate, "FUZZY_BLOCK", block)
    draw = random.Random(7)
    parts = ["run", "Sample", "tmt", "plex-1", "lab", "01", "02", "b", "x_y"]
    name = lambda: "_".join(draw.choices(parts, k=draw.randint(1, 5)))
    left = [(i, f"o {name()}") for i in range(11)] + [(11, None), (12, ""), (13, "o twin run"), (14, "o twin run")]
    right = [(100 + i, f"{name()}{i}") for i in range(9)] + [(109, "o-twin-run"), (110, None), (111, "?")]
    obs, table = spark.createDataFrame(left, "obs_pos long, k string"), spark.createDataFrame(right, "_row long, k string")
    for cutoff, margin in ((0.3, 0.0), (0.5, 0.05)):
        found, misses = annotate.match_fuzzy(obs, "k", table, "k", cutoff, margin)
        expected, near = brute_fuzzy(left, right, cutoff, margin)
        assert {tuple(r) for r in found.collect()} == expected and expected
        assert {(r[0], r[1]) for r in misses.collect()} == near
    found, misses = annotate.match_fuzzy(obs, "k", table.limit(0), "k", 0.3, 0.0)
    assert found.count() == 0 and misses.count() == 0
