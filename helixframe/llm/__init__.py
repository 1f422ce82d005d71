"""Operators of a training-data pipeline: ten of them, each in its own module.

Nothing else in the package imports this subpackage, so it can be removed as a whole.
"""
