"""Column functions."""

from helixframe.functions.arrays import array_quantile, array_summary_stats, comb, mean_substitute
from helixframe.functions.genotypes import call_summary_stats, dosages, dp_summary_stats, genotype_states, gq_summary_stats, hard_calls, hardy_weinberg, variant_type
from helixframe.functions.structs import (
    add_struct_fields,
    array_to_dense_vector,
    array_to_sparse_vector,
    assert_true_or_error,
    expand_struct,
    explode_matrix,
    matrix_literal,
    subset_struct,
    vector_to_array,
)

__all__ = [
    "add_struct_fields", "array_quantile", "array_summary_stats", "array_to_dense_vector", "array_to_sparse_vector", "assert_true_or_error",
    "call_summary_stats", "comb", "dosages", "dp_summary_stats", "expand_struct", "explode_matrix", "genotype_states", "gq_summary_stats", "hard_calls",
    "hardy_weinberg", "matrix_literal", "mean_substitute", "subset_struct", "variant_type", "vector_to_array",
]
