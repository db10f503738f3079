"""Operators on labelled arrays, as mixins of :class:`axisframe.LabeledArray`."""
