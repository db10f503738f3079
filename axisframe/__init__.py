"""Labelled N-dimensional arrays as Spark DataFrames."""

from .array import ArrayError, LabeledArray
from .operators.dataset import LabeledDataset
from .operators.reshape import concat, stack

__all__ = ["ArrayError", "LabeledArray", "LabeledDataset", "concat", "stack"]
