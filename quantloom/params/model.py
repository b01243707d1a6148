"""The record of a search's settings: a table of names by kind, compiled into one checked model."""

from __future__ import annotations

import re
from typing import Annotated, Any, Literal

from pydantic import BaseModel, ConfigDict, Field, computed_field, create_model, model_validator

from quantloom.functions.unimod import Known, unimod

# Spellings of "the file does not say".
MISSING = {"", "-", "none", "nan", "n/a", "na", "not specified", "unknown", "placeholder"}

_TOKEN = re.compile(r"(?P<target>[^\[\]]+)\[(?P<name>.+)\]")


class SearchedModification(BaseModel):
    """A modification as a file writes it, ``Target[identity]`` or an identity alone; the rest is looked up."""

    model_config = ConfigDict(frozen=True, extra="forbid")
    written: str
    mod_type: Literal["fixed", "variable", "unknown"] = "unknown"

    def _split(self) -> tuple[str | None, Known | None]:
        m = _TOKEN.fullmatch(self.written.strip())
        return (m["target"], unimod(m["name"])) if m else (None, unimod(self.written))

    @computed_field
    @property
    def name(self) -> str:
        target, known = self._split()
        return self.written if known is None else f"{target}[{known.name}]" if target else known.name

    @computed_field
    @property
    def accession(self) -> str | None:
        known = self._split()[1]
        return known and known.accession

    @computed_field
    @property
    def mass_delta(self) -> float | None:
        known = self._split()[1]
        return known and known.mass


def modification(token: str, kind: str) -> SearchedModification:
    """``Target[identity]`` with the identity resolved; unknown ones keep their text."""
    return SearchedModification(written=token, mod_type=kind)


class Tolerance(BaseModel):
    """A half-width around the theoretical mass; without one, the tool calibrates it itself."""

    model_config = ConfigDict(extra="forbid")
    value: Annotated[float, Field(ge=0)] | None = None
    unit: Literal["ppm", "Da"] | None = None
    label: str | None = None

    @computed_field
    @property
    def mode(self) -> str:
        return "automatic" if self.value is None else "absolute"

    @model_validator(mode="after")
    def _both(self):
        if (self.value is None) != (self.unit is None):
            raise ValueError("a half-width and its unit come together")
        return self


class _Record(BaseModel):
    model_config = ConfigDict(extra="forbid")

    @model_validator(mode="before")
    @classmethod
    def _say_nothing(cls, values: Any):
        """Texts that only say that nothing is known are left out."""
        said = lambda n, v: not (n in _MAY_SAY_NOTHING and isinstance(v, str) and v.strip().lower() in MISSING)
        return {n: v for n, v in values.items() if said(n, v)} if isinstance(values, dict) else values

    @model_validator(mode="after")
    def _ranges(self):
        for name in type(self).model_fields:
            if name.startswith("min_"):
                low, high = getattr(self, name), getattr(self, name.replace("min_", "max_", 1))
                if low is not None and high is not None and low > high:
                    raise ValueError(f"{name} {low} is above {high}")
        return self


_KINDS: dict[str, Any] = {
    "text": str, "yes": bool, "share": Annotated[float, Field(ge=0, le=1)], "count": Annotated[int, Field(ge=0)], "charge": Annotated[int, Field(gt=0)],
    "mz": Annotated[float, Field(ge=0)], "width": Tolerance, "text or yes": str | bool, "count or text": Annotated[int, Field(ge=0)] | str,
}
# The names of all settings, by kind.
_NAMES = {
    "text": "software_name software_version quantification_software quantification_software_version search_engine search_engine_version enzyme quantification_method protein_inference predictors_library",
    "share": "ident_fdr_psm ident_fdr_peptide ident_fdr_protein",
    "yes": "enable_match_between_runs semi_enzymatic combine_charge_states",
    "width": "precursor_mass_tolerance fragment_mass_tolerance",
    "count": "allowed_miscleavages min_peptide_length max_peptide_length max_mods",
    "charge": "min_precursor_charge max_precursor_charge",
    "mz": "min_precursor_mz max_precursor_mz min_fragment_mz max_fragment_mz",
    "text or yes": "abundance_normalization_ions",
    "count or text": "scan_window",
}
_MAY_SAY_NOTHING = {"software_version", "search_engine_version", "enzyme", "quantification_method", "protein_inference", "abundance_normalization_ions", "predictors_library"}

Parameters = create_model(
    "Parameters", __base__=_Record, acquisition_method=(Literal["DDA", "DIA", "unknown"], "unknown"),
    **{kind: (list[SearchedModification], Field(default_factory=list)) for kind in ("fixed_mods", "variable_mods")},
    **{name: (_KINDS[kind] | None, None) for kind, names in _NAMES.items() for name in names.split()},
)
