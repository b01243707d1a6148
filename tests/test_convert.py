"""End to end: rule documents over small files, stores, annotation, alignment."""

import json

import pytest
from pyspark.sql import functions as F

from quantloom import api
from quantloom.cli import main
from quantloom.errors import AnnotationError, CanonicalKeyCollisionError, DuplicateCellError, IncompatibleSourceError, ResultIOError, RuleNotApplicable
from quantloom.operators.align import observation_groups, select_observations, share_axis
from quantloom.operators.annotate import annotate
from quantloom.plans.rules import Catalog, Document, json_schema

DEFAULTS = {"var": {"type": "string", "required": True, "per_feature": "first"}, "obs": {"type": "string"}, "layers": {"encoding_mode": "numeric", "type": "number", "required": False}}


def long_rule(**level):
    own = {
        "axis": {"obs_keys": ["sample"], "var_keys": ["protein"]},
        "measurements": {"primary_layer": "Intensity", "repeated_cells": {"mode": "error"}, "layers": [{"name": "Intensity", "source": "Intensity", "roles": ["abundance"], "missing_values": ["<=0"]}]},
        "columns": {"obs": [{"name": "sample", "source": "sample"}], "var": [{"name": "protein", "source": "protein", "roles": ["protein_assignment"]}, {"name": "marked", "how": "decoy", "inputs": ["protein"], "prefix": "rev_", "separator": ";"}]},
    } | level
    return {"software_name": "Mini", "software_version_pattern": "^1", "hierarchy": "lfq", "tables": [{"input": {"shape": "long", "extensions": [".tsv", ".csv"]}, "base": {"defaults": DEFAULTS}, "levels": {"protein": own}}]}


WIDE = {
    "software_name": "MiniWide", "software_version_pattern": "^1", "hierarchy": "lfq",
    "tables": [{"input": {"shape": "wide", "extensions": [".tsv"]}, "base": {"defaults": DEFAULTS, "sample_pattern": "(?P<sample>.+)"}, "levels": {"protein": {
        "axis": {"obs_keys": ["sample"], "var_keys": ["protein"]},
        "measurements": {"primary_layer": "Intensity", "repeated_cells": {"mode": "same"}, "layers": [{"name": "Intensity", "source": "Intensity_{sample}"}]},
        "columns": {"var": [{"name": "protein", "source": "protein"}]},
    }}}],
}


def write(path, rows):
    path.write_text("\n".join("\t".join(map(str, r)) for r in rows) + "\n")
    return path


def cells(level, name="Intensity"):
    rows = level.layer(name).join(level.var, "var_pos").join(level.obs, "obs_pos").select(*level.var_keys, *level.obs_keys, "value").collect()
    return {tuple(r)[:-1]: r["value"] for r in rows}


@pytest.fixture
def long_file(tmp_path):
    return write(tmp_path / "long.tsv", [("protein", "sample", "Intensity"), ("P1", "a", 10), ("P1", "b", 11), ("rev_P2; P3", "a", 20), ("rev_P2; P3", "b", 0), ("", "b", 5)])


def test_long_and_wide_agree(spark, tmp_path, long_file):
    wide_file = write(tmp_path / "wide.tsv", [("protein", "Intensity_a", "Intensity_b"), ("P1", 10, 11), ("P2", 20, "")])
    long_file = write(tmp_path / "l2.tsv", [("protein", "sample", "Intensity"), ("P1", "a", 10), ("P1", "b", 11), ("P2", "a", 20)])
    one = api.Compiler.from_rule(spark, long_file, long_rule()).compile().parse()["protein"]
    two = api.Compiler.from_rule(spark, wide_file, WIDE).compile().parse()["protein"]
    assert cells(one) == cells(two) == {("P1", "a"): 10.0, ("P1", "b"): 11.0, ("P2", "a"): 20.0}
    assert [r["sample"] for r in two.obs.orderBy("obs_pos").collect()] == ["a", "b"]


def test_axes_positions_and_missing(spark, long_file):
    level = api.Compiler.from_rule(spark, long_file, long_rule()).compile().parse()["protein"]
    assert [tuple(r) for r in level.var.orderBy("var_pos").select("protein", "marked").collect()] == [("P1", False), ("rev_P2;P3", True)]
    assert cells(level) == {("P1", "a"): 10.0, ("P1", "b"): 11.0, ("rev_P2;P3", "a"): 20.0}  # 0 is a sentinel, the row without a key leaves
    wide = {r["var_pos"]: tuple(r)[1:] for r in level.wide("Intensity").collect()}
    assert wide == {0: (10.0, 11.0), 1: (20.0, None)}


def test_repeated_cells_and_collisions(spark, tmp_path):
    twice = write(tmp_path / "t.tsv", [("protein", "sample", "Intensity"), ("P1", "a", 1), ("P1", "a", 2)])
    with pytest.raises(DuplicateCellError):
        api.Compiler.from_rule(spark, twice, long_rule()).compile().parse()
    same = write(tmp_path / "s.tsv", [("protein", "sample", "Intensity"), ("P1,P2", "a", 1), ("P1;P2", "b", 2)])
    with pytest.raises(CanonicalKeyCollisionError):
        api.Compiler.from_rule(spark, same, long_rule()).compile().parse()
    with pytest.raises(IncompatibleSourceError):
        api.Compiler.from_rule(spark, write(tmp_path / "x.tsv", [("protein", "sample"), ("P", "a")]), long_rule()).compile().parse()


def test_ion_rule_with_sequences_and_keep_best(spark, tmp_path):
    rule = long_rule(
        axis={"obs_keys": ["sample"], "var_keys": ["ion"]},
        measurements={"primary_layer": "Intensity", "repeated_cells": {"mode": "keep_best", "by": "PEP", "best": "lowest", "sum": ["Intensity"]}, "layers": [{"name": "Intensity", "source": "Intensity"}, {"name": "PEP", "source": "PEP"}, {"name": "Type", "source": "Type", "encoding_mode": "factor", "categories": {"A": 0, "B": 1}}]},
        columns={"obs": [{"name": "sample", "source": "sample"}], "var": [
            {"name": "seq", "source": "seq"}, {"name": "z", "source": "z", "type": "integer"},
            {"name": "form", "how": "proforma_sequence", "inputs": ["seq"], "case_sensitive": False}, {"name": "bare", "how": "stripped_sequence", "inputs": ["seq"]},
            {"name": "ion", "how": "proforma_ion", "inputs": ["form", "z"]},
        ]},
        sequence_syntax={"vendor_sequence": {"parser": "token_regex", "token_pattern": r"^\((?P<nterm>[^()]*)\)|\((?P<residue>[^()]*)\)", "token_position": "after_residue"}},
        modification_map={"ox": "UNIMOD:35", "ac": "UNIMOD:1"},
    )
    rule["tables"][0]["levels"] = {"peptidoform_ion": rule["tables"][0]["levels"]["protein"]}
    file = write(tmp_path / "e.tsv", [("seq", "z", "sample", "Intensity", "PEP", "Type"), ("_(ac)PEM(ox)K_", 2, "a", 5, 0.1, "B"), ("_(ac)PEM(ox)K_", 2, "a", 7, 0.01, "A"), ("_PEM(zz)K_", 3, "b", 1, 0.5, "C")])
    level = api.Compiler.from_rule(spark, file, rule).compile().parse()["peptidoform_ion"]
    assert [tuple(r) for r in level.var.orderBy("var_pos").select("ion", "bare").collect()] == [("[UNIMOD:1]-PEM[UNIMOD:35]K/2", "PEMK"), ("PEM[zz]K/3", "PEMK")]
    assert sorted(tuple(r) for r in level.cells.select("var_pos", "obs_pos", "Intensity", "PEP", "Type").collect()) == [(0, 0, 12.0, 0.01, 0), (1, 1, 1.0, 0.5, -1)]
    assert level.uns["parse"]["computed"]["form"]["unknown_tokens"] == ["zz"]
    assert level.uns["parse"]["unreadable"]["Type"]["examples"] == ["C"]


def test_fragments(spark, tmp_path):
    rule = long_rule(
        axis={"obs_keys": ["sample"], "var_keys": ["fragment"]},
        measurements={"primary_layer": "Q", "repeated_cells": {"mode": "error"}, "layers": [{"name": "Q", "source": "Quant"}]},
        columns={"obs": [{"name": "sample", "source": "sample"}], "var": [{"name": "ion", "source": "ion"}, {"name": "gene", "source": "gene"}, {"name": "fragment", "how": "proforma_fragment", "inputs": ["ion", "fragment_label"]}]},
        fragments={"label_strategy": "positional", "value_columns": ["Quant"], "delimiter": ";"},
    )
    rule["tables"][0]["levels"] = {"peptidoform_fragment": rule["tables"][0]["levels"]["protein"]}
    file = write(tmp_path / "f.tsv", [("ion", "gene", "sample", "Quant"), ("P/2", "g", "a", "1;2;"), ("P/2", "g", "b", "3;;5")])
    level = api.Compiler.from_rule(spark, file, rule).compile().parse()["peptidoform_fragment"]
    assert cells(level, "Q") == {("P/2/frag_1", "a"): 1.0, ("P/2/frag_2", "a"): 2.0, ("P/2/frag_1", "b"): 3.0, ("P/2/frag_3", "b"): 5.0}
    assert {r["gene"] for r in level.var.collect()} == {"g"}


def test_stores_round_trip(spark, tmp_path, long_file):
    result = api.Compiler.from_rule(spark, long_file, long_rule()).compile().parse()
    for name in ("r.parquet", "r.duckdb"):
        api.write_levels(result, str(tmp_path / name))
        back = api.read_levels(spark, str(tmp_path / name))
        assert cells(back["protein"]) == cells(result["protein"])
        assert back["protein"].var.dtypes == result["protein"].var.dtypes
        assert back["protein"].layers == result["protein"].layers
    side = json.loads(api.publish(result, str(tmp_path / "r.parquet")).read_text())
    assert side["levels"]["protein"]["layers"]["Intensity"]["finite"] == 3
    with pytest.raises(ResultIOError):
        api.read_levels(spark, str(tmp_path / "nothing.parquet"))
    with pytest.raises(ResultIOError):
        api.write_levels(result, str(tmp_path / "r.h5ad"))


def test_annotation(spark, long_file):
    level = api.Compiler.from_rule(spark, long_file, long_rule()).compile().parse()["protein"]
    table = spark.createDataFrame([("a", "x", True), ("c", "y", False)], "raw_file string, condition string, use boolean")
    kept, seen = annotate(level, table)
    assert (seen.matched, seen.only_observations, seen.only_annotation) == (1, 1, 1)
    assert {r["sample"]: r["condition"] for r in kept.obs.collect()} == {"a": "x", "b": None}
    with pytest.raises(AnnotationError):
        annotate(level, table, unmatched="error")
    dropped, _ = annotate(level, table, unmatched="drop", include="use")
    assert cells(dropped) == {("P1", "a"): 10.0, ("rev_P2;P3", "a"): 20.0}
    with pytest.raises(AnnotationError):
        annotate(level, spark.createDataFrame([("zz", 1)], "raw_file string, g int"))
    near = spark.createDataFrame([("sample_a", 1), ("other", 2)], "raw_file string, g int")
    fuzzy, _ = annotate(level, near, fuzzy=(0.1, 0.05))
    assert {r["sample"]: r["g"] for r in fuzzy.obs.collect()}["a"] == 1


def test_alignment(spark, tmp_path):
    one = api.Compiler.from_rule(spark, write(tmp_path / "1.tsv", [("protein", "sample", "Intensity"), ("P", "a", 1), ("P", "b", 2)]), long_rule()).compile().parse()["protein"]
    two = api.Compiler.from_rule(spark, write(tmp_path / "2.tsv", [("protein", "sample", "Intensity"), ("Q", "c", 3), ("Q", "a", 4)]), long_rule()).compile().parse()["protein"]
    both = share_axis({"x": one, "y": two})
    assert [r["sample"] for r in both["x"].obs.orderBy("obs_pos").collect()] == [r["sample"] for r in both["y"].obs.orderBy("obs_pos").collect()] == ["a", "b", "c"]
    assert cells(both["y"]) == {("Q", "c"): 3.0, ("Q", "a"): 4.0}
    less = select_observations(two, two.obs.filter(F.col("sample") == "a").select("obs_pos"))
    assert cells(less) == {("Q", "a"): 4.0} and less.obs.first()["obs_pos"] == 0
    from quantloom.result import Levels
    assert len(observation_groups(Levels({"protein": one}))) == 1


def test_detection_and_gates(tmp_path):
    first = long_rule(requires_search_parameters={"combine": True})
    doc = Document(first)
    with pytest.raises(RuleNotApplicable):
        doc.rule("protein", {"combine": False})
    assert doc.rule("protein", {"combine": True}).level == "protein"
    catalog = Catalog([Document(long_rule()), Document(WIDE)])
    assert catalog.detect(header=("protein", "Intensity_a")).name == "MiniWide"
    assert catalog.detect("mini", "1.2").name == "Mini"
    assert "properties" in json_schema()


def test_cli(spark, tmp_path, long_file, monkeypatch):
    monkeypatch.setattr("quantloom.cli._session", lambda: spark)
    rule = tmp_path / "rules.json"
    rule.write_text(json.dumps(long_rule()))
    out = tmp_path / "out.parquet"
    assert main(["convert", str(long_file), "protein", "--rule", str(rule), "--output", str(out)]) == 0
    assert main(["reformat", str(out), str(tmp_path / "out.duckdb")]) == 0
    assert main(["convert", str(long_file), "gene", "--rule", str(rule), "--output", str(out)]) == 1
