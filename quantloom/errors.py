"""Errors that a conversion may end with; each message holds at most five examples."""

from __future__ import annotations

EXAMPLES = 5


class ConversionError(Exception):
    """Any expected failure of a conversion."""


class IncompatibleSourceError(ConversionError):
    """The header or format does not fit the rule."""


class AmbiguousDialectError(ConversionError):
    """Several dialects fit one file."""


class LayerValueError(ConversionError):
    """A value does not fit its layer's type."""


class LayerContractError(ConversionError):
    """A required layer is missing or empty."""


class ColumnComputationError(ConversionError):
    """A computed column got input it can't use."""


class DuplicateCellError(ConversionError):
    """A cell repeats where its policy forbids it."""


class AggregateTypeError(ConversionError):
    """A numeric aggregate met text that is no number."""


class CanonicalKeyCollisionError(ConversionError):
    """Distinct raw keys give one final key."""


class AxisCoercionError(ConversionError):
    """An axis token can't be read as its type."""


class UnknownModificationError(ConversionError):
    """A modification token that the map does not name."""


class PackedSiteMismatchError(ConversionError):
    """Modification names and sites do not go together."""


class UnplaceableModificationError(ConversionError):
    """A modification token without a residue."""


class UnrecognizedSequenceCharacterError(ConversionError):
    """A character that is no residue and part of no token."""


class PackedLengthError(ConversionError):
    """Parallel packed lists of one row differ in length."""


class RuleDetectionError(ConversionError):
    """No rule can be chosen."""


class RuleUnavailableError(RuleDetectionError):
    """No rule covers the software, version or level."""


class AmbiguousRuleError(RuleDetectionError):
    """Several rules fit."""


class RuleNotApplicable(RuleDetectionError):
    """The rule's gate excludes this input."""


class InputPreparationError(ConversionError):
    """Tables can't be joined or split as the rule asks."""


class MzTabFormatError(InputPreparationError):
    """The text is no well-formed mzTab."""


class ResultIOError(ConversionError):
    """A stored result is invalid or unsupported."""


class StorageLabelError(ResultIOError):
    """No free prefix for stored labels."""


class AnnotationError(ConversionError):
    """A sample annotation is refused."""


class ParamsError(ConversionError):
    """A parameter file can't be read."""


def some(values) -> str:
    """Up to five examples of a collection, as text."""
    values = list(values)
    return ", ".join(map(repr, values[:EXAMPLES]))
