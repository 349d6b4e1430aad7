"""Paired sparse tensor analytics expressed as Spark DataFrame jobs."""

from pairlens.schema import PairedTensor, coord_names, factor_names

__all__ = ["PairedTensor", "coord_names", "factor_names"]
