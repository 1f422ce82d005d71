"""Genomic analytics on PySpark: sources, functions, joins, transformers and association tests as DataFrame operations."""

from helixframe.functions import *  # noqa: F403
from helixframe.functions import __all__ as _functions
from helixframe.functions.genome import lift_over_coordinates, normalize_variant
from helixframe.functions.regression import linear_regression_gwas, logistic_regression_gwas
from helixframe.operators.overlap_join import left_overlap_join, left_semi_overlap_join
from helixframe.operators.registry import register_transformer, transform
from helixframe.operators.sample_stats import merge_variants, sample_call_summary_stats, sample_dp_summary_stats, sample_gq_summary_stats
from helixframe.session import reader, register, writer

__all__ = [
    *_functions, "left_overlap_join", "left_semi_overlap_join", "lift_over_coordinates", "linear_regression_gwas", "logistic_regression_gwas", "merge_variants", "normalize_variant",
    "reader", "register", "register_transformer", "sample_call_summary_stats", "sample_dp_summary_stats", "sample_gq_summary_stats", "transform", "writer",
]
