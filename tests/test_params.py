"""Parameter files: one small text for each format family, and the refusals."""

import json

import pytest

from quantloom.errors import ParamsError
from quantloom.params import Parameters, Tolerance, read_parameters
from quantloom.params.model import modification, unimod

SAGE = {
    "version": "0.14", "precursor_tol": {"ppm": [-10, 10]}, "fragment_tol": {"da": [-0.02, 0.02]}, "precursor_charge": [2, 4], "quant": {"lfq_settings": {"combine_charge_states": False}},
    "database": {"enzyme": {"missed_cleavages": 2, "min_len": 7, "max_len": 30, "cleave_at": "KR", "restrict": "P"}, "static_mods": {"C": 57.0215}, "variable_mods": {"M": [15.9949], "[": [42.0106]}, "max_variable_mods": 3},
}
MQPAR = "<MaxQuantParams><maxQuantVersion>2.1</maxQuantVersion><peptideFdr>0.01</peptideFdr><proteinFdr>0.02</proteinFdr><matchBetweenRuns>True</matchBetweenRuns><minPepLen>7</minPepLen><msmsParamsArray><msmsParams><Name>FTMS</Name><MatchTolerance>20</MatchTolerance><MatchToleranceInPpm>True</MatchToleranceInPpm></msmsParams><msmsParams><Name>ITMS</Name><MatchTolerance>0.5</MatchTolerance><MatchToleranceInPpm>False</MatchToleranceInPpm></msmsParams></msmsParamsArray><parameterGroups><parameterGroup><mainSearchTol>4.5</mainSearchTol><enzymes><string>Trypsin/P</string></enzymes><enzymeMode>0</enzymeMode><maxMissedCleavages>2</maxMissedCleavages><maxNmods>5</maxNmods><maxCharge>7</maxCharge><fixedModifications><string>Carbamidomethyl (C)</string></fixedModifications><variableModifications><string>Oxidation (M)</string><string>Acetyl (Protein N-term)</string></variableModifications></parameterGroup></parameterGroups></MaxQuantParams>"
DIANN = 'DIA-NN 1.8.1 (Data)\ndiann.exe --f a.raw --qvalue 0.01 --cut K*,R* --missed-cleavages 1 --min-pep-len 7 --max-pep-len 30 --unimod4 --var-mod UniMod:35,15.994915,M --mass-acc 15 --reanalyse\n'
PEAKS = "PEAKS Version: 13\nEnzyme: Trypsin\nPrecursor Mass Error Tolerance: 10 ppm\nFragment Mass Error Tolerance: Auto Detected\nPrecursor FDR: 1%\nPeptide Length between: 6, 45\nVariable Modifications:\n- Oxidation (M) (+15.99)\nMatch Between Run: Yes\n"
WORKFLOW = "# FragPipe version 22.0\n# MSFragger version 4.1\n" + "\n".join(f"{k}={v}" for k, v in {
    "msfragger.search_enzyme_name_1": "stricttrypsin", "msfragger.search_enzyme_name_2": "null", "msfragger.allowed_missed_cleavage_1": "2", "msfragger.num_enzyme_termini": "2", "msfragger.precursor_mass_lower": "-20", "msfragger.precursor_mass_upper": "20", "msfragger.precursor_mass_units": "1",
    "msfragger.fragment_mass_tolerance": "20", "msfragger.fragment_mass_units": "1", "msfragger.max_variable_mods_per_peptide": "3", "msfragger.digest_min_length": "7", "msfragger.digest_max_length": "50", "phi-report.filter": "--psm 0.02 --prot 0.03",
    "msfragger.table.fix-mods": "0.0,C-Term Peptide,true,-1; 57.02146,C (cysteine),true,-1", "msfragger.table.var-mods": "15.9949,M,true,3; 42.0106,[^,true,1; 79.96633,STY,false,3", "quantitation.run-label-free-quant": "true", "ionquant.mbr": "1",
}.items())


def read(tmp_path, text, software):
    path = tmp_path / "p"
    path.write_text(text)
    return read_parameters(path, software)


def names(mods):
    return [(m.name, m.accession) for m in mods]


def test_json(tmp_path):
    r = read(tmp_path, json.dumps(SAGE), "Sage")
    assert (r.enzyme, r.combine_charge_states, r.min_precursor_charge, r.max_peptide_length) == ("Trypsin", False, 2, 30)
    assert r.precursor_mass_tolerance == Tolerance(value=10, unit="ppm") and r.fragment_mass_tolerance.unit == "Da"
    assert names(r.variable_mods) == [("M[Oxidation]", "UNIMOD:35"), ("Protein N-term[Acetyl]", "UNIMOD:1")]
    with pytest.raises(ParamsError):
        read(tmp_path, json.dumps(SAGE | {"precursor_tol": {"ppm": [-5, 10]}}), "Sage")


def test_xml(tmp_path):
    r = read(tmp_path, MQPAR, "MaxQuant")
    assert (r.software_version, r.enzyme, r.enable_match_between_runs, r.semi_enzymatic, r.max_mods) == ("2.1", "Trypsin/P", True, False, 5)
    assert r.fragment_mass_tolerance == Tolerance(value=20, unit="ppm")
    assert names(r.fixed_mods) == [("C[Carbamidomethyl]", "UNIMOD:4")] and names(r.variable_mods)[1] == ("Protein N-term[Acetyl]", "UNIMOD:1")


def test_command_labels_and_pairs(tmp_path):
    r = read(tmp_path, DIANN, "DIA-NN")
    assert (r.software_version, r.enzyme, r.enable_match_between_runs, r.allowed_miscleavages) == ("1.8.1", "Trypsin/P", True, 1)
    assert names(r.fixed_mods) == [("C[Carbamidomethyl]", "UNIMOD:4")] and names(r.variable_mods) == [("M[Oxidation]", "UNIMOD:35")]
    p = read(tmp_path, PEAKS, "PEAKS")
    assert (p.min_peptide_length, p.max_peptide_length, p.ident_fdr_psm, p.fragment_mass_tolerance.mode) == (6, 45, 0.01, "automatic")
    assert names(p.variable_mods) == [("M[Oxidation]", "UNIMOD:35")]
    f = read(tmp_path, WORKFLOW, "FragPipe")
    assert (f.software_version, f.search_engine_version, f.enzyme, f.ident_fdr_psm, f.ident_fdr_peptide) == ("22.0", "4.1", "Trypsin/P", 0.02, 0.01)
    assert [m.accession for m in f.variable_mods] == ["UNIMOD:35", "UNIMOD:1"] and len(f.fixed_mods) == 1


TOML = """[SearchParameters]
DoParsimony = true
MatchBetweenRuns = true
Normalize = false
[CommonParameters]
ListOfModsFixed = "Common Fixed\\tCarbamidomethyl on C"
ListOfModsVariable = "Common Variable\\tOxidation on M\\t\\tCommon Biological\\tAcetylation on X (Prot N-Term)"
PrecursorMassTolerance = "±5.0000 PPM"
ProductMassTolerance = "±0.0200 Absolute"
QValueThreshold = 0.01
[CommonParameters.DigestionParams]
Protease = "trypsin"
MaxMissedCleavages = 2
MinPeptideLength = 7
MaxPeptideLength = 30
MaxModsForPeptide = 2
"""
QUANTMS = {"acquisition_method": "dda", "enzyme": "Trypsin", "allowed_missed_cleavages": 1, "precursor_mass_tolerance": 5, "precursor_mass_tolerance_unit": "ppm", "fragment_mass_tolerance": 0.03, "fragment_mass_tolerance_unit": "Da", "fixed_mods": "Carbamidomethyl (C)", "variable_mods": "Oxidation (M),Phospho (ST)", "psm_level_fdr_cutoff": 0.01, "protein_level_fdr_cutoff": 0.01, "min_precursor_charge": 2, "max_precursor_charge": 4, "min_peptide_length": 6, "max_peptide_length": 40, "max_mods": 3, "protein_inference_method": "aggregation", "quantification_method": "feature_intensity"}


def test_pairs_in_any_order(tmp_path):
    (tmp_path / "s.toml").write_text(TOML)
    (tmp_path / "v.txt").write_text("MetaMorpheus: version 1.0.5\nmore\n")
    for order in ((0, 1), (1, 0)):
        files = [tmp_path / "s.toml", tmp_path / "v.txt"]
        r = read_parameters([files[i] for i in order], "MetaMorpheus")
        assert (r.software_version, r.enzyme, r.protein_inference, r.fragment_mass_tolerance.unit) == ("1.0.5", "Trypsin", "Parsimony", "Da")
        assert names(r.variable_mods) == [("M[Oxidation]", "UNIMOD:35"), ("Protein N-term[Acetyl]", "UNIMOD:1")]
    with pytest.raises(ParamsError):
        read_parameters(tmp_path / "s.toml", "MetaMorpheus")
    (tmp_path / "p.json").write_text(json.dumps(QUANTMS))
    (tmp_path / "v.yml").write_text("Workflow:\n  nf-core/quantms: 1.3\nSEARCHENGINECOMET:\n  Comet: 2023.01\n")
    q = read_parameters([tmp_path / "v.yml", tmp_path / "p.json"], "quantms")
    assert (q.acquisition_method, q.search_engine, len(q.variable_mods), q.max_mods) == ("DDA", "comet", 3, 3)


def test_log_and_workbook(tmp_path):
    log = "0:00:00.01 PROGRESS: version: 1.10\n0:00:01.2 INFO: ├──precursor_len: \n0:00:01.2 INFO: │   7\n0:00:01.2 INFO: │   35\n0:00:01.2 INFO: ├──enzyme: trypsin\n0:00:01.2 INFO: ├──missed_cleavages: 1 [user defined, default: 2]\n0:00:01.2 INFO: ├──variable_modifications: Oxidation@M;Acetyl@Protein_N-term\n0:00:01.2 INFO: ├──target_ms1_tolerance: 0\n"
    r = read(tmp_path, log, "AlphaDIA")
    assert (r.software_version, r.enzyme, r.allowed_miscleavages, r.min_peptide_length, r.max_peptide_length, r.precursor_mass_tolerance.mode) == ("1.10", "Trypsin", 1, 7, 35, "automatic")
    assert names(r.variable_mods) == [("M[Oxidation]", "UNIMOD:35"), ("Protein N-term[Acetyl]", "UNIMOD:1")]
    from quantloom.sources.workbook import write_sheets

    search = [["software_name", "Mascot"], ["software_version", "2.8"], ["enzymes", "Trypsin"], ["max_missed_cleavages", "2"], ["fixed_ptms", "Carbamidomethyl (C)"], ["variable_ptms", "Oxidation (M)"], ["peptide_charge_states", "2+ and 3+"], ["peptide_mass_error_tolerance", "5 ppm"], ["fragment_mass_error_tolerance", "0.02 Da"]]
    write_sheets(tmp_path / "w.xlsx", {"Search settings and infos": search, "Import and filters": [["psm_filter_expected_fdr", "1.0"], ["psm_filter_2", "[threshold_value=7]"]], "Quant config": [["Cross Assignment", "x"]]})
    w = read_parameters(tmp_path / "w.xlsx", "ProlineStudio")
    assert (w.search_engine, w.min_precursor_charge, w.max_precursor_charge, w.min_peptide_length, w.ident_fdr_psm, w.enable_match_between_runs) == ("Mascot", 2, 3, 7, 0.01, True)


def test_refusals(tmp_path):
    for text, software in (("{}", "sage"), ("nothing", "diann"), ("<a/>", "maxquant"), ("x", "nosuchtool")):
        with pytest.raises(ParamsError):
            read(tmp_path, text, software)
    with pytest.raises(ValueError):
        Parameters(min_peptide_length=9, max_peptide_length=3)
    with pytest.raises(ValueError):
        Tolerance(value=1)
    assert modification("X[odd]", "fixed").accession is None and unimod("79.9663")[0] == "UNIMOD:21"
