"""Text of identifiers and packed lists: column expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The twenty amino acids, and the letters for rare and unknown ones.
RESIDUES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters around a sequence that mark its ends.
END_MARKS = "_-."


def quoted(literal: str) -> str:
    return "\\Q" + literal + "\\E" if literal else ""


def protein_list(col: Column, separator: str | None = None) -> Column:
    """Commas, semicolons and the vendor's separator become semicolons without blanks."""
    marks = [",", ";"] + ([separator] if separator and separator not in ",;" else [])
    pattern = r"\s*(?:" + "|".join(quoted(m) for m in marks) + r")\s*"
    return F.regexp_replace(F.trim(col.cast("string")), pattern, ";")


def coalesce_text(*cols: Column) -> Column:
    return F.coalesce(*[c.cast("string") for c in cols])


def join_nonempty(separator: str, *cols: Column) -> Column:
    """Present values joined; null without any."""
    joined = F.concat_ws(separator, *[c.cast("string") for c in cols])
    return F.when(F.coalesce(*[c.cast("string") for c in cols]).isNotNull(), joined)


def marker(col: Column, *, equals: str | None = None, prefix: str | None = None, separator: str | None = None) -> Column:
    """Boolean that is never null: equal to a value, or (any list member) begins with a prefix."""
    text = col.cast("string")
    if equals is not None:
        found = text == equals
    elif separator:
        found = F.exists(F.split(text, quoted(separator)), lambda x: F.startswith(F.trim(x), F.lit(prefix)))
    else:
        found = F.startswith(text, F.lit(prefix))
    return F.coalesce(found, F.lit(False))


def proforma_ion(sequence: Column, charge: Column) -> Column:
    """``sequence/charge``; null where either is missing or the charge is not positive."""
    return F.when(charge > 0, F.concat(sequence, F.lit("/"), charge.cast("long").cast("string")))


def proforma_fragment(ion: Column, label: Column) -> Column:
    return F.concat(ion, F.lit("/"), label)


def plain_sequence(col: Column) -> Column:
    return F.btrim(col, F.lit(END_MARKS))


def strip_tokens(col: Column, token_pattern: str, marker_pattern: str | None = None) -> Column:
    """Residues without tokens and markers (Java patterns)."""
    text = F.regexp_replace(col, marker_pattern, "") if marker_pattern else col
    return F.btrim(F.regexp_replace(F.btrim(text, F.lit(END_MARKS)), token_pattern, ""), F.lit(END_MARKS))


def java_pattern(pattern: str) -> str:
    """A Python pattern's named groups in Java's spelling."""
    return pattern.replace("(?P<", "(?<")


def not_residues(col: Column) -> Column:
    return col.rlike("[^A-Z]")


# ------------------------------------------------------------------ packed lists
def _without_end(col: Column, delimiter: str) -> Column:
    text = F.trim(col.cast("string"))
    return F.regexp_replace(text, f"(?:{quoted(delimiter)})+$", "")


def packed_split(col: Column, delimiter: str) -> Column:
    """Tokens of a packed cell, trimmed; a closing delimiter opens no token, a hole is null.

    Null and blank cells have no tokens.
    """
    body = _without_end(col, delimiter)
    tokens = F.transform(F.split(body, quoted(delimiter)), lambda x: F.when(F.trim(x) != "", F.trim(x)))
    return F.when(F.coalesce(body, F.lit("")) == "", F.array().cast("array<string>")).otherwise(tokens)


def packed_count(col: Column, delimiter: str) -> Column:
    return F.size(packed_split(col, delimiter))


def count_literal(col: Column, literal: str) -> Column:
    return (F.size(F.split(col, quoted(literal))) - 1).cast("long")


def column_label(token: Column) -> Column:
    """The first segment of a label such as ``b3/…``."""
    return F.split_part(token, F.lit("/"), F.lit(1))


def positional_label(position: Column) -> Column:
    return F.concat(F.lit("frag_"), position.cast("string"))


# -------------------------------------------------------------------- file names
# Extensions of mass-spectrometry files.
MS_EXTENSIONS = ("mzml.gz", "mzml", "raw", "mgf", "d", "wiff")
_EXTENSION = r"(?i)\.(?:" + "|".join(quoted(x) for x in MS_EXTENSIONS) + r")$"


def ms_basename(col: Column) -> Column:
    """File name without folders and without a mass-spectrometry extension."""
    return F.regexp_replace(F.regexp_replace(col.cast("string"), r"^.*[/\\]", ""), _EXTENSION, "")


def sanitize_name(name: str) -> str:
    """A column name in plain ASCII: other characters become underscores."""
    import unicodedata

    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    return re.sub(r"[^A-Za-z0-9_.]", "_", plain) or "_"


def cv_name(term: str) -> str:
    """The name inside a controlled-vocabulary term ``[label, accession, name, value]``."""
    inner = re.fullmatch(r"\s*\[(.*)\]\s*", term)
    if not inner:
        return term
    parts = [p.strip().strip('"') for p in inner.group(1).split(",")]
    return parts[2] if len(parts) > 2 and parts[2] else term
