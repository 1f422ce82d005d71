"""Whole-genome regression: stacked ridge models over a block genotype matrix."""

from helixframe.wgr.blocks import block_variants_and_samples, get_sample_ids, reshape_for_gwas
from helixframe.wgr.estimate import estimate_loco_offsets
from helixframe.wgr.logistic import LogisticRidgeRegression
from helixframe.wgr.reduction import RidgeReduction
from helixframe.wgr.regression import RidgeRegression

__all__ = ["LogisticRidgeRegression", "RidgeReduction", "RidgeRegression", "block_variants_and_samples", "estimate_loco_offsets", "get_sample_ids", "reshape_for_gwas"]
