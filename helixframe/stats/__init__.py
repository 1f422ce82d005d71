"""Numerical kernels on numpy."""
