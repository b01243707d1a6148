"""Readers: each file becomes flat (path, values) settings, each record field names its settings.

A reader is data: how to flatten the file, and for every field of the record the
setting it comes from and how its text converts.  What needs several settings is a
function of all of them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import Any
from xml.etree import ElementTree

from pydantic import ValidationError

from quantloom.errors import ParamsError
from quantloom.params.model import Parameters, Tolerance, modification


class Settings(dict):
    """Flat settings: a path such as ``database/enzyme/min_len`` to its values."""

    def one(self, *paths: str, default: Any = None) -> Any:
        for p in paths:
            if self.get(p):
                return self[p][0]
        return default

    def need(self, *paths: str) -> Any:
        found = self.one(*paths)
        if found is None:
            raise ParamsError(f"setting {' or '.join(paths)} is missing")
        return found

    def under(self, path: str) -> list:
        """Values at a path or below it, in file order; empty elements don't count."""
        return [v for p, values in self.items() if p == path or p.startswith(path + "/") for v in values if v is not None]


def _walk(value, path: str, out: Settings) -> Settings:
    if isinstance(value, dict):
        for k, v in value.items():
            _walk(v, f"{path}/{k}" if path else str(k), out)
    elif isinstance(value, list):
        for v in value:
            _walk(v, path, out)
    else:
        out.setdefault(path, []).append(value)
    return out


def from_json(text: str) -> Settings:
    return _walk(json.loads(text), "", Settings())


def from_yaml(text: str) -> Settings:
    import yaml

    return _walk(yaml.safe_load(text), "", Settings())


def from_xml(text: str) -> Settings:
    out = Settings()

    def walk(element, path):
        for child in element:
            below = f"{path}/{child.tag}" if path else child.tag
            for k, v in child.attrib.items():
                out.setdefault(f"{below}@{k}", []).append(v)
            if len(child):
                walk(child, below)
            else:
                out.setdefault(below, []).append((child.text or "").strip() or None)

    walk(ElementTree.fromstring(text), "")
    return out


def from_pairs(separator: str) -> Callable[[str], Settings]:
    def read(text: str) -> Settings:
        out = Settings()
        for line in text.splitlines():
            key, found, value = line.partition(separator)
            if found and not key.lstrip().startswith("#"):
                out.setdefault(key.strip(), []).append(value.strip())
        out["#"] = [line for line in text.splitlines() if line.startswith("#")]
        return out

    return read


def from_labels(text: str) -> Settings:
    """``Label: value`` lines; ``- item`` lines belong to the label before them."""
    out, label = Settings(), None
    lines = [re.sub(r"^[\s│├─└]*", "", x).strip() for x in text.splitlines()]
    out["#"] = lines
    for line in lines:
        if line.startswith("- ") and label:
            out.setdefault(label, []).append(line[2:].strip())
        elif ":" in line:
            label, _, value = line.partition(":")
            label = label.strip()
            value = value.strip(" \t,:")
            out[label] = out.get(label, []) + [value] if value else []
    return out


# ------------------------------------------------------------------ conversions
def width(value, unit: str) -> Tolerance:
    names = {"ppm": "ppm", "da": "Da", "daltons": "Da", "th": "Da"}
    if str(unit).strip().lower() not in names:
        raise ParamsError(f"unknown unit of a tolerance: {unit!r}")
    return Tolerance(value=float(value), unit=names[str(unit).strip().lower()])


def interval(low, high, unit: str) -> Tolerance:
    if abs(float(low) + float(high)) > 1e-9:
        raise ParamsError(f"tolerance is not symmetric: {low} to {high}")
    return width(abs(float(high)), unit)


def written(text: str | None) -> Tolerance | None:
    """``20 ppm``, ``0.02Da``, ``Dynamic``."""
    if text is None:
        return None
    if text.strip().lower() in ("dynamic", "automatic", "auto", "auto detected"):
        return Tolerance(label="Automatic calibration")
    m = re.fullmatch(r"\s*([0-9.]+)\s*([A-Za-z]+)\s*", text)
    if not m:
        raise ParamsError(f"unreadable tolerance {text!r}")
    return width(m[1], m[2])


def yes(value) -> bool | None:
    return None if value is None else str(value).strip().lower() in ("true", "yes", "1", "t")


def number(value, kind=int):
    return None if value in (None, "") else kind(float(str(value).replace(",", ".")))


def percent(value) -> float | None:
    return None if value is None else (float(value.removesuffix("%")) / 100 if str(value).endswith("%") else float(value))


def bracketed(entry: str, targets: dict[str, str] | None = None) -> list[str]:
    """``Phospho (ST)`` to ``S[Phospho]``, ``T[Phospho]``; ends keep their whole name."""
    m = re.fullmatch(r"(.+?)\s*\(([^()]*)\)\s*(?:\([^()]*\))?", entry.strip())
    if not m:
        return [(targets or {}).get(entry.strip(), entry.strip())]
    if "term" in m[2].lower():
        return [f"{m[2]}[{m[1]}]"]
    return [f"{c}[{m[1]}]" for c in m[2]]


def named_of(entry: str) -> list[str]:
    """``Oxidation of M`` to ``M[Oxidation]``."""
    name, found, target = entry.strip().partition(" of ")
    if not found:
        return [entry.strip()]
    return [f"{target.strip() if 'term' in target.lower() else target.strip().upper()}[{name}]"]


def mods(entries, split: Callable[[str], list[str]], kind: str) -> list:
    return [modification(t, kind) for e in entries for t in split(str(e)) if str(e).strip()]


def parts(value, separator: str = ",") -> list[str]:
    return [x.strip() for x in str(value or "").split(separator) if x.strip()]


# ---------------------------------------------------------------------- readers
@dataclass(frozen=True)
class Reader:
    flatten: Callable[[str], Settings]
    fields: dict[str, Any]  # a text is a setting path, a function gets all settings, other values stand

    def __call__(self, content) -> Parameters:
        try:
            own = self.flatten(content)
            values = {}
            for name, source in self.fields.items():
                values[name] = source(own) if callable(source) else source
            return Parameters(**values)
        except (ValidationError, ValueError, KeyError, TypeError, AttributeError, IndexError, ElementTree.ParseError) as e:
            raise ParamsError(f"unreadable parameter file: {e}") from e


def at(*paths: str, to: Callable = lambda x: x) -> Callable[[Settings], Any]:
    return lambda s: to(s.one(*paths))


def must(*paths: str, to: Callable = lambda x: x) -> Callable[[Settings], Any]:
    return lambda s: to(s.need(*paths))


# Ends in one tool's residue symbols.
_SAGE_ENDS = {"^": "N-term", "$": "C-term", "[": "Protein N-term", "]": "Protein C-term"}


def _sage_mods(path: str, kind: str):
    def read(s: Settings):
        pairs = [(p.rpartition("/")[2], v) for p, values in s.items() if p.startswith(path + "/") for v in values]
        return [modification(f"{_SAGE_ENDS.get(r, r)}[{v}]", kind) for r, v in pairs]

    return read


def _sage_width(path: str):
    def read(s: Settings):
        unit = "ppm" if f"{path}/ppm" in s else "da"
        low, high = s[f"{path}/{unit}"]
        return interval(low, high, unit)

    return read


def _sage_enzyme(s: Settings) -> str:
    sites = s.need("database/enzyme/cleave_at")
    return sites if set(sites) != set("KR") else ("Trypsin" if s.one("database/enzyme/restrict") == "P" else "Trypsin/P")


SAGE = Reader(from_json, {
    "software_name": "Sage", "software_version": must("version"), "search_engine": "Sage", "search_engine_version": must("version"),
    "combine_charge_states": lambda s: (s.one("quant/lfq_settings/combine_charge_states", default=True) if any(p.startswith("quant/lfq_settings/") for p in s) else None),
    "enzyme": _sage_enzyme, "semi_enzymatic": lambda s: bool(s.one("database/enzyme/semi_enzymatic")), "allowed_miscleavages": must("database/enzyme/missed_cleavages"),
    "fixed_mods": _sage_mods("database/static_mods", "fixed"), "variable_mods": _sage_mods("database/variable_mods", "variable"),
    "precursor_mass_tolerance": _sage_width("precursor_tol"), "fragment_mass_tolerance": _sage_width("fragment_tol"),
    "min_peptide_length": must("database/enzyme/min_len"), "max_peptide_length": at("database/enzyme/max_len"), "max_mods": must("database/max_variable_mods"),
    "min_precursor_charge": lambda s: s["precursor_charge"][0], "max_precursor_charge": lambda s: s["precursor_charge"][1], "enable_match_between_runs": True,
})

WOMBAT = Reader(from_yaml, {
    "software_name": "WOMBAT-P", "software_version": must("version", to=str), "search_engine": "various",
    "enzyme": must("params/enzyme", to=lambda x: "Trypsin" if x == "trypsin" else x), "allowed_miscleavages": must("params/miscleavages"),
    "fixed_mods": lambda s: mods(parts(s.one("params/fixed_mods")), named_of, "fixed"), "variable_mods": lambda s: mods(parts(s.one("params/variable_mods")), named_of, "variable"),
    "max_mods": must("params/max_mods"), "min_peptide_length": must("params/min_peptide_length"), "max_peptide_length": must("params/max_peptide_length"),
    "precursor_mass_tolerance": must("params/precursor_mass_tolerance", to=written), "fragment_mass_tolerance": must("params/fragment_mass_tolerance", to=written),
    "ident_fdr_protein": must("params/ident_fdr_protein"), "ident_fdr_peptide": must("params/ident_fdr_peptide"), "ident_fdr_psm": must("params/ident_fdr_psm"),
    "min_precursor_charge": must("params/min_precursor_charge"), "max_precursor_charge": must("params/max_precursor_charge"),
    "enable_match_between_runs": must("params/enable_match_between_runs"), "abundance_normalization_ions": at("params/normalization_method"),
})

# Short modification names of one tool.
_ALPHAPEPT = {"cC": "C[Carbamidomethyl]", "oxM": "M[Oxidation]", "a<^": "Protein N-term[Acetyl]", "a<": "N-term[Acetyl]", "pS": "S[Phospho]", "pT": "T[Phospho]", "pY": "Y[Phospho]"}


def _alphapept_mods(kind: str, key: str):
    return lambda s: mods([v for end in ("", "_terminal", "_terminal_prot") for v in s.get(f"fasta/{key}{end}", []) if v], lambda x: [_ALPHAPEPT.get(x.strip(), x.strip())], kind)


ALPHAPEPT = Reader(from_yaml, {
    "software_name": "AlphaPept", "software_version": must("summary/version"), "search_engine": "AlphaPept", "search_engine_version": must("summary/version"),
    "enzyme": must("fasta/protease", to=lambda x: "Trypsin" if x == "trypsin" else x), "allowed_miscleavages": must("fasta/n_missed_cleavages"),
    "fixed_mods": _alphapept_mods("fixed", "mods_fixed"), "variable_mods": _alphapept_mods("variable", "mods_variable"), "max_mods": must("fasta/n_modifications_max"),
    "min_peptide_length": must("fasta/pep_length_min"), "max_peptide_length": must("fasta/pep_length_max"),
    "precursor_mass_tolerance": lambda s: width(s.need("search/prec_tol"), "ppm" if s.one("search/ppm") else "Da"), "fragment_mass_tolerance": lambda s: width(s.need("search/frag_tol"), "ppm" if s.one("search/ppm") else "Da"),
    "ident_fdr_protein": must("search/protein_fdr"), "ident_fdr_psm": must("search/peptide_fdr"),
    "min_precursor_charge": must("features/iso_charge_min"), "max_precursor_charge": must("features/iso_charge_max"), "enable_match_between_runs": must("workflow/match"),
})


def _mqpar_fragment(s: Settings, name: str):
    base = "msmsParamsArray/msmsParams"  # newer files have elements, older ones attributes
    names = s.get(f"{base}/Name") or s.get(f"{base}@Name") or []
    values = s.get(f"{base}/{name}") or s.get(f"{base}@{name}") or []
    return values[names.index("FTMS")]


_MQ = {"Cys-Cys": "C[Disulfide]", "Cysteinyl": "C[Cysteinyl]", "Cysteinyl - carbamidomethyl": "C[Cysteinyl + Carbamidomethyl]"}
_MQ_GROUP = "parameterGroups/parameterGroup"
MAXQUANT = Reader(from_xml, {
    "software_name": "MaxQuant", "software_version": must("maxQuantVersion"), "search_engine": "Andromeda",
    "ident_fdr_psm": must("peptideFdr", to=float), "ident_fdr_protein": must("proteinFdr", to=float), "enable_match_between_runs": must("matchBetweenRuns", to=yes),
    "precursor_mass_tolerance": lambda s: width(s.need(f"{_MQ_GROUP}/mainSearchTol"), "ppm"),
    "fragment_mass_tolerance": lambda s: width(_mqpar_fragment(s, "MatchTolerance"), "ppm" if yes(_mqpar_fragment(s, "MatchToleranceInPpm")) else "Da"),
    "enzyme": lambda s: next(iter(s.under(f"{_MQ_GROUP}/enzymes")), None), "semi_enzymatic": must(f"{_MQ_GROUP}/enzymeMode", to=lambda x: int(x) != 0),
    "allowed_miscleavages": must(f"{_MQ_GROUP}/maxMissedCleavages", to=int), "min_peptide_length": must("minPepLen", "minPeptideLength", to=int),
    "fixed_mods": lambda s: mods(s.under(f"{_MQ_GROUP}/fixedModifications") or s.under("fixedModifications"), lambda e: bracketed(e, _MQ), "fixed"),
    "variable_mods": lambda s: mods(s.under(f"{_MQ_GROUP}/variableModifications"), lambda e: bracketed(e, _MQ), "variable"),
    "max_mods": must(f"{_MQ_GROUP}/maxNmods", to=int), "max_precursor_charge": must(f"{_MQ_GROUP}/maxCharge", to=int),
})


def _mascot(key: str, to=str):
    return must(f"operations/searchEnginesWithForms/paramMap/{key}", to=to)


def _charges(s: Settings) -> list[int]:
    return [int(x) for x in re.findall(r"(\d+)\+", str(s.one("operations/searchEnginesWithForms/paramMap/CHARGE", default="")))]


MSANGEL = Reader(from_json, {
    "software_name": "MSAngel", "software_version": must("msAngelVersion"), "quantification_software": "MSAngel", "quantification_software_version": must("msAngelVersion"),
    "acquisition_method": "DDA", "search_engine": lambda s: next(x for x in s.under("operations/searchEnginesWithForms") if x == "Mascot"),
    "ident_fdr_psm": at("operations/validationConfig/psmExpectedFdr", to=lambda x: None if x is None else float(x) / 100), "enable_match_between_runs": True,
    "precursor_mass_tolerance": lambda s: width(_mascot("TOL")(s), _mascot("TOLU")(s)), "fragment_mass_tolerance": lambda s: width(_mascot("ITOL")(s), _mascot("ITOLU")(s)),
    "enzyme": _mascot("CLE"), "allowed_miscleavages": _mascot("PFA", number),
    "fixed_mods": lambda s: mods(parts(s.one("operations/searchEnginesWithForms/paramMap/MODS")), bracketed, "fixed"), "variable_mods": lambda s: mods(parts(s.one("operations/searchEnginesWithForms/paramMap/IT_MODS")), bracketed, "variable"),
    "min_precursor_charge": lambda s: min(_charges(s), default=None), "max_precursor_charge": lambda s: max(_charges(s), default=None),
})


def _fdr_option(option: str):
    return lambda s: float(m[1]) if (m := re.search(rf"--{option}\s+(\d+\.\d+)", s.one("phi-report.filter", default=""))) else 0.01


def _fragger_enzyme(s: Settings) -> str:
    names = [x for x in (s.need("msfragger.search_enzyme_name_1"), s.one("msfragger.search_enzyme_name_2", default="null")) if x != "null"]
    return {"stricttrypsin": "Trypsin/P", "trypsin": "Trypsin"}.get("|".join(names), "|".join(names))


# End symbols of one tool's modification table.
_FRAGGER_ENDS = {"n^": "N-term", "c^": "C-term", "[^": "Protein N-term", "]^": "Protein C-term"}


def _fragger_mods(path: str, kind: str):
    """Rows ``mass,site,enabled,count`` of a table; rows that are off or weigh nothing don't count."""

    def read(s: Settings):
        out = []
        for row in parts(s.one(path), ";"):
            mass, site, on, *_ = [x.strip() for x in row.split(",")]
            if yes(on) and float(mass):
                site = re.sub(r"\s*\(.*\)$", "", site)
                out += [modification(f"{t}[{mass}]", kind) for t in ([_FRAGGER_ENDS[site]] if site in _FRAGGER_ENDS else [site] if "term" in site.lower() else list(site))]
        return out

    return read


def _comment(label: str):
    return lambda s: next((line.split()[-1] for line in s["#"] if line.startswith(f"# {label}")), None)


FRAGPIPE = Reader(from_pairs("="), {
    "software_name": "FragPipe", "software_version": _comment("FragPipe version"), "search_engine": "MSFragger", "search_engine_version": _comment("MSFragger version"),
    "enzyme": _fragger_enzyme, "allowed_miscleavages": must("msfragger.allowed_missed_cleavage_1", to=number), "semi_enzymatic": must("msfragger.num_enzyme_termini", to=lambda x: x != "2"),
    "precursor_mass_tolerance": lambda s: interval(s.need("msfragger.precursor_mass_lower"), s.need("msfragger.precursor_mass_upper"), "ppm" if s.need("msfragger.precursor_mass_units") != "0" else "Da"),
    "fragment_mass_tolerance": lambda s: width(s.need("msfragger.fragment_mass_tolerance"), "ppm" if s.need("msfragger.fragment_mass_units") != "0" else "Da"),
    "fixed_mods": _fragger_mods("msfragger.table.fix-mods", "fixed"), "variable_mods": _fragger_mods("msfragger.table.var-mods", "variable"),
    "max_mods": must("msfragger.max_variable_mods_per_peptide", to=number), "min_peptide_length": must("msfragger.digest_min_length", to=number), "max_peptide_length": must("msfragger.digest_max_length", to=number),
    "ident_fdr_psm": _fdr_option("psm"), "ident_fdr_peptide": _fdr_option("pep"), "ident_fdr_protein": _fdr_option("prot"),
    "enable_match_between_runs": lambda s: yes(s.one("ionquant.mbr")) if yes(s.one("quantitation.run-label-free-quant")) else None,
    "protein_inference": lambda s: f"ProteinProphet: {s.need('protein-prophet.cmd-opts')}" if yes(s.one("protein-prophet.run-protein-prophet")) else None,
    "min_precursor_charge": lambda s: number(s.need("msfragger.misc.fragger.precursor-charge-lo")) if yes(s.one("msfragger.override_charge")) else 1,
    "max_precursor_charge": lambda s: number(s.need("msfragger.misc.fragger.precursor-charge-hi")) if yes(s.one("msfragger.override_charge")) else None,
})


def _bounds(which: int, *labels: str):
    return lambda s: int(re.findall(r"\d+", s.need(*labels))[which]) if s.one(*labels) else None


PEAKS = Reader(from_labels, {
    "software_name": "PEAKS", "software_version": at("PEAKS Version"), "search_engine": "PEAKS", "search_engine_version": at("PEAKS Version"),
    "ident_fdr_psm": at("Precursor FDR", "PSM FDR", to=percent), "ident_fdr_peptide": at("Peptide FDR", to=percent), "ident_fdr_protein": at("Protein Group FDR", to=percent),
    "enable_match_between_runs": at("Match Between Run", to=yes), "enzyme": at("Enzyme"), "semi_enzymatic": at("Digest Mode", to=lambda x: None if x is None else x != "Specific"),
    "precursor_mass_tolerance": at("Precursor Mass Error Tolerance", to=lambda x: written("40 ppm" if x == "System Default" else x)),
    "fragment_mass_tolerance": at("Fragment Mass Error Tolerance", to=lambda x: written("40 ppm" if x == "System Default" else x)),
    "allowed_miscleavages": at("Max Missed Cleavage", "Missed Cleavage", to=number), "max_mods": at("Max Variable PTM per Peptide", to=number),
    "min_peptide_length": _bounds(0, "Peptide Length between", "Peptide Length Range", "Peptide Length"), "max_peptide_length": _bounds(1, "Peptide Length between", "Peptide Length Range", "Peptide Length"),
    "min_precursor_charge": _bounds(0, "Precursor Charge between", "Charge between"), "max_precursor_charge": _bounds(1, "Precursor Charge between", "Charge between"),
    "fixed_mods": lambda s: mods(s.get("Fixed Modifications", []), bracketed, "fixed"), "variable_mods": lambda s: mods(s.get("Variable Modifications", []), bracketed, "variable"),
    "quantification_method": at("LFQ Method", "Q Method"), "abundance_normalization_ions": at("Normalization Method", "Normalization"),
})

SPECTRONAUT = Reader(from_labels, {
    "software_name": "Spectronaut", "software_version": lambda s: s["#"][0].split()[1], "search_engine": "Spectronaut", "search_engine_version": lambda s: s["#"][0].split()[1],
    "ident_fdr_psm": at("Precursor Qvalue Cutoff", to=lambda x: number(x, float)), "ident_fdr_protein": at("Protein Qvalue Cutoff (Experiment)", to=lambda x: number(x, float)), "enable_match_between_runs": False,
    "enzyme": at("Enzymes / Cleavage Rules"), "semi_enzymatic": at("Digest Type", to=lambda x: x != "Specific"), "allowed_miscleavages": must("Missed Cleavages", to=number),
    "min_peptide_length": must("Min Peptide Length", to=number), "max_peptide_length": must("Max Peptide Length", to=number), "max_mods": must("Max Variable Modifications", to=number),
    "fixed_mods": lambda s: mods(parts(s.one("Fixed Modifications")), lambda e: bracketed(e, _MQ), "fixed"), "variable_mods": lambda s: mods(parts(s.one("Variable Modifications")), lambda e: bracketed(e, _MQ), "variable"),
    "scan_window": at("XIC IM Extraction Window"), "quantification_method": at("Quantity MS Level"), "protein_inference": at("Inference Algorithm"), "abundance_normalization_ions": at("Cross-Run Normalization"),
})


def from_command(text: str) -> Settings:
    """Options of the first ``diann`` command line, and the log's lines."""
    line = next((x for x in text.splitlines() if re.search(r"diann\S*\s+--", x)), None)
    version = re.search(r"DIA-NN\s+([0-9][^\s(]*)", text)
    if line is None and version is None:
        raise ParamsError("no command line and no version of DIA-NN")
    out = Settings({"version": [version[1]] if version else []})
    for option in re.split(r"\s--", line or "")[1:]:
        name, *values = option.split()
        out.setdefault(name, []).append(" ".join(values))
    out["#"] = text.splitlines()
    return out


def _diann_mods(option: str, kind: str):
    """``UniMod:35,15.994915,M``; ``*n`` is the protein N-terminus, ``n`` any."""

    def read(s: Settings):
        out = []
        for value in s.get(option, []):
            name, _, rest = value.partition(",")
            sites = rest.rpartition(",")[2]
            targets = [{"*n": "Protein N-term", "n": "N-term"}.get(sites, sites)] if sites in ("*n", "n") else list(sites)
            out += [modification(f"{t}[{name}]", kind) for t in targets] or [modification(name, kind)]
        if kind == "fixed" and "unimod4" in s:
            out.append(modification("C[Carbamidomethyl]", kind))
        return out

    return read


DIANN = Reader(from_command, {
    "fixed_mods": _diann_mods("mod", "fixed"), "variable_mods": _diann_mods("var-mod", "variable"),
    "software_name": "DIA-NN", "software_version": at("version"), "search_engine": "DIA-NN", "search_engine_version": at("version"),
    "acquisition_method": lambda s: "DDA" if "dda" in s else "DIA", "enable_match_between_runs": lambda s: "reanalyse" in s, "ident_fdr_psm": at("qvalue", to=lambda x: number(x, float)),
    "enzyme": at("cut", to=lambda x: {"K*,R*": "Trypsin/P", "K*,R*,!P": "Trypsin"}.get(x, x)), "allowed_miscleavages": at("missed-cleavages", to=number),
    "min_peptide_length": at("min-pep-len", to=number), "max_peptide_length": at("max-pep-len", to=number), "max_mods": at("var-mods", to=number),
    "min_precursor_charge": at("min-pr-charge", to=number), "max_precursor_charge": at("max-pr-charge", to=number),
    "min_precursor_mz": at("min-pr-mz", to=lambda x: number(x, float)), "max_precursor_mz": at("max-pr-mz", to=lambda x: number(x, float)), "min_fragment_mz": at("min-fr-mz", to=lambda x: number(x, float)), "max_fragment_mz": at("max-fr-mz", to=lambda x: number(x, float)),
    "precursor_mass_tolerance": at("mass-acc-ms1", to=lambda x: None if x is None else width(x, "ppm")), "fragment_mass_tolerance": at("mass-acc", to=lambda x: None if x is None else width(x, "ppm")),
    "protein_inference": lambda s: "Disabled" if "no-prot-inf" in s else s.one("pg-level", default="Genes"),
    "quantification_method": lambda s: "Legacy" if "direct-quant" in s else "QuantUMS high-accuracy" if "high-acc" in s else "QuantUMS high-precision",
    "abundance_normalization_ions": lambda s: None if "no-norm" in s else "Cross-run normalization", "scan_window": at("window", to=number),
})


def _tandem(s: Settings) -> bool:
    return "tandem" in s.need("AnalysisSoftware_name").lower()


I2MASSCHROQ = Reader(from_pairs("\t"), {
    "software_name": "i2MassChroQ", "software_version": must("i2MassChroQ_VERSION"), "quantification_software": "i2MassChroQ", "quantification_software_version": must("i2MassChroQ_VERSION"),
    "acquisition_method": "DDA", "search_engine": must("AnalysisSoftware_name", to=lambda x: x.replace("X! ", "X!")), "search_engine_version": at("AnalysisSoftware_version", "sage_version"),
    "ident_fdr_psm": at("psm_fdr", to=lambda x: number(x, float)), "ident_fdr_peptide": at("peptide_fdr", to=lambda x: number(x, float)), "ident_fdr_protein": at("protein_fdr", to=lambda x: number(x, float)),
    "enable_match_between_runs": at("mcq_mbr", to=lambda x: x == "T"),
    "precursor_mass_tolerance": lambda s: interval("-" + s.need("spectrum, parent monoisotopic mass error minus"), s.need("spectrum, parent monoisotopic mass error plus"), s.need("spectrum, parent monoisotopic mass error units")) if _tandem(s) else interval(*s.need("sage_precursor_tol").split()),
    "fragment_mass_tolerance": lambda s: width(s.need("spectrum, fragment monoisotopic mass error"), s.need("spectrum, fragment monoisotopic mass error units")) if _tandem(s) else interval(*s.need("sage_fragment_tol").split()),
    "enzyme": at("protein, cleavage site", "sage_database_enzyme_cleave_at"), "semi_enzymatic": at("protein, cleavage semi", to=lambda x: x == "yes"),
    "allowed_miscleavages": at("scoring, maximum missed cleavage sites", "sage_database_enzyme_missed_cleavages", to=number), "max_precursor_charge": at("spectrum, maximum parent charge", to=number),
})

# ------------------------------------------------------------- pairs of files
def from_toml(text: str) -> Settings:
    import tomllib

    return _walk(tomllib.loads(text), "", Settings())


def from_pair(*kinds: tuple[Callable[[str], bool], Callable[[str], Settings]]) -> Callable[[str], Settings]:
    """Several files joined by a form feed, in any order, each read by the kind that knows it."""

    def read(text: str) -> Settings:
        out, seen = Settings(), set()
        for part in text.split("\f"):
            fits = [i for i, (knows, _) in enumerate(kinds) if knows(part) and i not in seen]
            if not fits:
                raise ParamsError("a file of the pair is of no known kind")
            seen.add(fits[0])
            out |= kinds[fits[0]][1](part)
        if len(seen) < len(kinds):
            raise ParamsError(f"{len(kinds)} files are needed, {len(seen)} are there")
        return out

    return read


_META_ENDS = {"(Prot N-Term)": "Protein N-term", "(Pep N-Term)": "N-term", "(Prot C-Term)": "Protein C-term", "(Pep C-Term)": "C-term"}


def _meta_mods(path: str, kind: str):
    """Blocks ``Group<tab>Name on Target``, two tabs between blocks."""

    def read(s: Settings):
        tokens = []
        for block in s.one(path, default="").split("\t\t"):
            name, found, target = block.partition("\t")[2].partition(" on ")
            end = next((t for mark, t in _META_ENDS.items() if mark in target), target.strip())
            if name:
                tokens.append(f"{end}[{name.strip()}]" if found else name.strip())
        return [modification(t, kind) for t in tokens]

    return read


def _meta_width(path: str):
    """``±10.0000 PPM`` and ``±0.0200 Absolute``."""

    def read(s: Settings):
        m = re.search(r"([0-9.]+)\s*([A-Za-z]+)", s.need(path))
        return width(m[1], "Da" if m[2].lower() == "absolute" else m[2])

    return read


_COMMON = "CommonParameters"
METAMORPHEUS = Reader(from_pair((lambda t: "[CommonParameters]" in t, from_toml), (lambda t: "version" in t.split("\n")[0].lower(), lambda t: Settings({"version": [t.split("\n")[0].split()[2]]}))), {
    "software_name": "MetaMorpheus", "software_version": must("version"), "search_engine": "MetaMorpheus", "quantification_method": "FlashLFQ",
    "enzyme": must(f"{_COMMON}/DigestionParams/Protease", to=lambda x: {"trypsin": "Trypsin", "trypsin/p": "Trypsin/P"}.get(x.lower(), x)), "allowed_miscleavages": must(f"{_COMMON}/DigestionParams/MaxMissedCleavages"),
    "min_peptide_length": must(f"{_COMMON}/DigestionParams/MinPeptideLength"), "max_peptide_length": must(f"{_COMMON}/DigestionParams/MaxPeptideLength"), "max_mods": must(f"{_COMMON}/DigestionParams/MaxModsForPeptide"),
    "fixed_mods": _meta_mods(f"{_COMMON}/ListOfModsFixed", "fixed"), "variable_mods": _meta_mods(f"{_COMMON}/ListOfModsVariable", "variable"),
    "precursor_mass_tolerance": _meta_width(f"{_COMMON}/PrecursorMassTolerance"), "fragment_mass_tolerance": _meta_width(f"{_COMMON}/ProductMassTolerance"),
    "min_precursor_charge": at(f"{_COMMON}/PrecursorDeconvolutionParameters/MinAssumedChargeState"), "max_precursor_charge": at(f"{_COMMON}/PrecursorDeconvolutionParameters/MaxAssumedChargeState"),
    "enable_match_between_runs": at("SearchParameters/MatchBetweenRuns"), "protein_inference": at("SearchParameters/DoParsimony", to=lambda x: "Parsimony" if x else None),
    "abundance_normalization_ions": at("SearchParameters/Normalize"), "ident_fdr_psm": at(f"{_COMMON}/QValueThreshold"),
})


def _engines(s: Settings) -> list[str]:
    return list(dict.fromkeys(p.split("/")[0].removeprefix("SEARCHENGINE").lower() for p in s if p.startswith("SEARCHENGINE")))


QUANTMS = Reader(from_pair((lambda t: t.lstrip().startswith("{"), from_json), (lambda t: "Workflow" in t, from_yaml)), {
    "software_name": "quantms", "software_version": must("Workflow/bigbio/quantms", "Workflow/nf-core/quantms", to=str), "quantification_software": "quantms", "quantification_software_version": must("Workflow/bigbio/quantms", "Workflow/nf-core/quantms", to=str),
    "acquisition_method": must("acquisition_method", to=str.upper), "search_engine": lambda s: ",".join(_engines(s)) or None,
    "search_engine_version": lambda s: ",".join(str(v) for p, vs in s.items() if p.startswith("SEARCHENGINE") and p.split("/")[-1] in ("Comet", "msgf_plus") for v in vs) or None,
    "enzyme": must("enzyme"), "allowed_miscleavages": must("allowed_missed_cleavages"),
    "precursor_mass_tolerance": lambda s: width(s.need("precursor_mass_tolerance"), s.need("precursor_mass_tolerance_unit")), "fragment_mass_tolerance": lambda s: width(s.need("fragment_mass_tolerance"), s.need("fragment_mass_tolerance_unit")),
    "fixed_mods": lambda s: mods(parts(s.one("fixed_mods")), bracketed, "fixed"), "variable_mods": lambda s: mods(parts(s.one("variable_mods")), bracketed, "variable"),
    "ident_fdr_psm": must("psm_level_fdr_cutoff"), "ident_fdr_protein": must("protein_level_fdr_cutoff"), "min_precursor_charge": must("min_precursor_charge"), "max_precursor_charge": must("max_precursor_charge"),
    "min_peptide_length": must("min_peptide_length"), "max_peptide_length": must("max_peptide_length"), "max_mods": must("max_mods"), "protein_inference": must("protein_inference_method"), "quantification_method": must("quantification_method"),
})

# ------------------------------------------------------- run logs and workbooks
def from_log(text: str) -> Settings:
    """A run log's configuration tree: first value of each key, bounds from the lines below a bare key."""
    out, open_key = Settings(), None
    for line in re.sub(r"(?:\x9b|\x1b\[)[0-?]*[ -/]*[@-~]", "", text).splitlines():
        if "version" not in out and (m := re.search(r"PROGRESS:\s*version:\s*(\S+)", line)):
            out["version"] = [m[1]]
            continue
        body = re.sub(r"^(?:\d+ days?,\s*)?\d+:\d{2}:\d{2}\.?\d*\s*(?:PROGRESS|INFO|WARNING|ERROR|CRITICAL|DEBUG):", "", line)
        body = re.sub(r"\s*[\[(]\s*user defined.*$", "", re.sub(r"[│├└─]+", "", body)).strip()
        key, found, value = (x.strip() for x in body.partition(":"))
        if open_key and not found and (m := re.fullmatch(r"(?:-\s+)?(-?\d+)", body)):
            out[open_key].append(int(m[1]))
        elif found and value:
            out.setdefault(key, [value])
            open_key = None
        elif found:
            open_key = key if key not in out else None
            if open_key:
                out[open_key] = []
    if "version" not in out:
        raise ParamsError("no version banner")
    return out


def _log_width(key: str):
    """Tolerances in ppm; 0 is calibrated from the data."""
    return lambda s: None if s.one(key) is None else (width(abs(float(s.one(key))), "ppm") if float(s.one(key)) else Tolerance(label="Automatic calibration"))


def _named_at(key: str, kind: str):
    """``Oxidation@M;Acetyl@Protein_N-term``."""
    return lambda s: [modification(f"{t.replace('_', ' ')}[{n}]" if t else n, kind) for n, _, t in (x.partition("@") for x in parts(s.one(key), ";"))]


ALPHADIA = Reader(from_log, {
    "software_name": "AlphaDIA", "software_version": must("version"), "search_engine": "AlphaDIA", "search_engine_version": must("version"), "acquisition_method": "DIA",
    "ident_fdr_psm": at("fdr", to=lambda x: number(x, float)), "ident_fdr_protein": at("fdr", to=lambda x: number(x, float)), "enable_match_between_runs": at("mbr_step_enabled", to=yes),
    "precursor_mass_tolerance": _log_width("target_ms1_tolerance"), "fragment_mass_tolerance": _log_width("target_ms2_tolerance"),
    "enzyme": at("enzyme", to=lambda x: {"trypsin": "Trypsin", "trypsin/p": "Trypsin/P"}.get(str(x).lower(), x)), "allowed_miscleavages": at("missed_cleavages", to=number),
    "min_peptide_length": lambda s: next(iter(s.get("precursor_len", [])), None), "max_peptide_length": lambda s: next(iter(s.get("precursor_len", [])[1:]), None),
    "min_precursor_charge": lambda s: next(iter(s.get("precursor_charge", [])), None), "max_precursor_charge": lambda s: next(iter(s.get("precursor_charge", [])[1:]), None),
    "fixed_mods": _named_at("fixed_modifications", "fixed"), "variable_mods": _named_at("variable_modifications", "variable"), "max_mods": at("max_var_mod_num", to=number),
    "quantification_method": "DirectLFQ", "predictors_library": "AlphaPeptDeep",
})


def from_workbook(path) -> Settings:
    """Sheets with the setting in the first column; a setting must be the same in all others."""
    from quantloom.sources.workbook import sheet_names, sheet_rows

    out = Settings()
    for sheet in sheet_names(path):
        for row in sheet_rows(path, sheet):
            if row and row[0]:
                out[f"{sheet}/{row[0]}"] = list(dict.fromkeys(v for v in row[1:] if v is not None))
    return out


def _constant(path: str, to: Callable = str):
    def read(s: Settings):
        values = s.get(path, [])
        if len(values) != 1:
            raise ParamsError(f"setting {path} is not constant: {values}")
        return to(values[0])

    return read


_SEARCH, _STATS = "Search settings and infos", "Dataset statistics and infos"
PROLINESTUDIO = Reader(from_workbook, {
    "software_name": "ProlineStudio", "software_version": at(f"{_STATS}/version"), "quantification_software": "ProlineStudio", "quantification_software_version": at(f"{_STATS}/version"), "acquisition_method": "DDA",
    "search_engine": _constant(f"{_SEARCH}/software_name"), "search_engine_version": _constant(f"{_SEARCH}/software_version"), "ident_fdr_psm": _constant("Import and filters/psm_filter_expected_fdr", lambda x: float(x) / 100),
    "enable_match_between_runs": lambda s: any(p.startswith("Quant config/") and "cross assignment" in p.lower() for p in s),
    "precursor_mass_tolerance": _constant(f"{_SEARCH}/peptide_mass_error_tolerance", written), "fragment_mass_tolerance": _constant(f"{_SEARCH}/fragment_mass_error_tolerance", written),
    "enzyme": _constant(f"{_SEARCH}/enzymes"), "allowed_miscleavages": _constant(f"{_SEARCH}/max_missed_cleavages", number),
    "min_peptide_length": at("Import and filters/psm_filter_2", to=lambda x: int(m[1]) if (m := re.search(r"threshold_value=(\d+)", str(x))) else None),
    "fixed_mods": lambda s: mods(parts(_constant(f"{_SEARCH}/fixed_ptms")(s), ";"), bracketed, "fixed"), "variable_mods": lambda s: mods(parts(_constant(f"{_SEARCH}/variable_ptms")(s), ";"), bracketed, "variable"),
    "min_precursor_charge": _constant(f"{_SEARCH}/peptide_charge_states", lambda x: min(map(int, re.findall(r"(\d+)\+", x)))), "max_precursor_charge": _constant(f"{_SEARCH}/peptide_charge_states", lambda x: max(map(int, re.findall(r"(\d+)\+", x)))),
})

READERS: dict[str, Reader] = {
    "alphadia": ALPHADIA, "alphapept": ALPHAPEPT, "diann": DIANN, "fragpipe": FRAGPIPE, "i2masschroq": I2MASSCHROQ, "maxquant": MAXQUANT, "metamorpheus": METAMORPHEUS, "msangel": MSANGEL,
    "peaks": PEAKS, "prolinestudio": PROLINESTUDIO, "quantms": QUANTMS, "sage": SAGE, "spectronaut": SPECTRONAUT, "wombat": WOMBAT,
}


def read_parameters(path: str | Path | list, software: str) -> Parameters:
    """The record of one parameter file, or of a pair of files in any order."""
    key = re.sub(r"[^a-z0-9]", "", software.lower())
    key = {"wombatp": "wombat"}.get(key, key)
    if key not in READERS:
        raise ParamsError(f"no parameter reader for {software!r}; there are {sorted(READERS)}")
    files = path if isinstance(path, (list, tuple)) else [path]
    if READERS[key].flatten is from_workbook:
        return READERS[key](files[0])
    return READERS[key]("\f".join(Path(p).read_text(encoding="utf-8", errors="replace").removeprefix("\ufeff") for p in files))
