"""Search-parameter files as one typed record."""

from quantloom.params.model import Parameters, SearchedModification, Tolerance
from quantloom.params.readers import READERS, read_parameters

__all__ = ["READERS", "Parameters", "SearchedModification", "Tolerance", "read_parameters"]
