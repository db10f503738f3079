"""The labelled array: all operators on one relational form."""

from __future__ import annotations

from .operators.align import Align
from .operators.base import ArrayError, Base
from .operators.group import Group
from .operators.reduce import Reduce
from .operators.reshape import Reshape
from .operators.scalar import Scalar
from .operators.select import Selection
from .operators.window import Windowed


class LabeledArray(Selection, Reshape, Align, Reduce, Group, Windowed, Scalar, Base):
    """N-dimensional numbers with labelled dimensions, as a DataFrame of cells."""


__all__ = ["ArrayError", "LabeledArray"]
