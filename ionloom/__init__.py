"""Spark-native analytics for non-target mass-spectrometry feature tables."""

from ionloom.model import Params

__all__ = ["Params"]
