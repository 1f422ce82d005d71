"""Offsets for association tests in one call."""

from __future__ import annotations

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from helixframe.wgr.logistic import LogisticRidgeRegression
from helixframe.wgr.reduction import RidgeReduction
from helixframe.wgr.regression import RidgeRegression


def estimate_loco_offsets(block_df: DataFrame, label_df: pd.DataFrame, sample_blocks: dict[str, list[str]], cov_df: pd.DataFrame = pd.DataFrame({}), add_intercept: bool = True, reduction_alphas: list[float] = [], regression_alphas: list[float] = [], label_type: str = "detect", chromosomes: list[str] = []) -> pd.DataFrame:
    """Predictions by sample id and contig, each without that contig's variants: ridge reduction and the last level that the labels ask for."""
    reduction = RidgeReduction(block_df, label_df, sample_blocks, cov_df, add_intercept, reduction_alphas, label_type)
    held = reduction.fit_transform().persist(StorageLevel.DISK_ONLY)
    reduction.reduced_block_df = held
    try:
        if reduction.is_binary() and label_type != "quantitative":
            return LogisticRidgeRegression.from_ridge_reduction(reduction, regression_alphas).fit_transform_loco("linear", chromosomes)
        return RidgeRegression.from_ridge_reduction(reduction, regression_alphas).fit_transform_loco(chromosomes)
    finally:
        held.unpersist()
