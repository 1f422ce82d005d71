"""The last level for quantitative labels: ridge over all reduced headers, its penalty chosen by cross-validated r2."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from helixframe.wgr import base, ridge
from helixframe.wgr.reduction import RidgeReduction, Stack

KEYS = ["sample_block", "label"]
PREDICTED = "sample_block string, label string, contigName string, predicted array<double>"


class LastLevel(Stack):
    """Cross-validation and predictions that both kinds of labels share."""

    metric = "r2"

    def __init__(self, reduced_block_df: DataFrame, label_df: pd.DataFrame, sample_blocks: dict[str, list[str]], cov_df: pd.DataFrame = pd.DataFrame({}), add_intercept: bool = True, alphas: list[float] = [], label_type: str = "detect") -> None:
        super().__init__(reduced_block_df, label_df, sample_blocks, cov_df, add_intercept, alphas, label_type)
        self.y_hat_df: pd.DataFrame | None = None

    @classmethod
    def from_ridge_reduction(cls, reduction: RidgeReduction, alphas: list[float] = []):
        out = cls(reduction.reduced_block_df, reduction.label_df, reduction.sample_blocks, reduction.cov_df, True, alphas)
        out.std_covariates = reduction.std_covariates
        return out

    @staticmethod
    def score(xb: np.ndarray, y: np.ndarray) -> np.ndarray:
        return 1 - ((y - xb) ** 2).sum(0) / ((y - y.mean()) ** 2).sum()

    def scored(self, labels: pd.DataFrame) -> DataFrame:
        """The model on the sample block that it left out: (sample_block, label, alpha, score)."""
        shared, score = self.shared(labels), self.score

        def run(key: tuple, block: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
            labels, covariates, samples = shared.value
            sample_block, label = key
            block = base.ordered(block)
            y = ridge.of_label(labels, label).loc[samples[sample_block]].to_numpy(float)
            known = ~np.isnan(y[:, 0])
            xb = ridge.design(block, covariates, samples[sample_block]) @ ridge.coefficients(model, block, covariates.shape[1])
            return pd.DataFrame({"sample_block": sample_block, "label": label, "alpha": list(model["alphas"].iloc[0]), "score": score(xb[known], y[known])})

        return self.blocks.groupBy(*KEYS).cogroup(self.model_df.groupBy(*KEYS)).applyInPandas(run, "sample_block string, label string, alpha string, score double")

    def predicted(self, chromosomes: list[str], covariates_too: bool, finish) -> DataFrame:
        """Predictions with the best penalty, without the headers of each chromosome in turn ("" leaves none out)."""
        shared = self.shared(self.label_df)
        best = self.cv_df.selectExpr("label", "alpha AS best")

        def run(key: tuple, block: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
            _, covariates, samples = shared.value
            sample_block, label = key
            block = base.ordered(block)
            used = covariates if covariates_too else pd.DataFrame({})
            x = ridge.design(block, used, samples[sample_block])
            at = list(model["alphas"].iloc[0]).index(model["best"].iloc[0])
            b = ridge.coefficients(model, block, used.shape[1])[:, at]
            own = np.array([None] * used.shape[1] + [base.chromosome_of(h) for h in block["header"]], object)
            rows = [(sample_block, label, c, finish(x @ np.where(own == c, 0.0, b))) for c in chromosomes]
            return pd.DataFrame(rows, columns=["sample_block", "label", "contigName", "predicted"])

        chosen = self.fitted().join(best, "label")
        return self.blocks.groupBy(*KEYS).cogroup(chosen.groupBy(*KEYS)).applyInPandas(run, PREDICTED)

    def chromosomes(self, given: list[str]) -> list[str]:
        from pyspark.sql import functions as F

        if given:
            return sorted(given)
        found = self.blocks.select(F.regexp_extract("header", r"^chr_(.+?)_(alpha|block)", 1).alias("c")).distinct().collect()
        return sorted(r["c"] for r in found)

    def shaped(self, df: DataFrame, contigs: bool) -> pd.DataFrame:
        """As large as labels times chromosomes, the size of what the caller asks for."""
        self.y_hat_df = base.wide(df.toPandas(), self.sample_blocks, self.label_df, contigs)
        return self.y_hat_df


class RidgeRegression(LastLevel):
    def fit(self) -> tuple[DataFrame, DataFrame]:
        shared = self.shared(self.std_labels)
        self.model_df = ridge.solved(ridge.equations(self.blocks, KEYS, shared), self.alphas, shared)
        self.cv_df = base.best_alphas(self.scored(self.std_labels), self.alphas, self.metric)
        return self.model_df, self.cv_df

    def transform(self) -> pd.DataFrame:
        return self.shaped(self.predicted([""], True, np.asarray), False)

    def transform_loco(self, chromosomes: list[str] = []) -> pd.DataFrame:
        return self.shaped(self.predicted(self.chromosomes(chromosomes), True, np.asarray), True)

    def fit_transform(self) -> pd.DataFrame:
        self.fit()
        return self.transform()

    def fit_transform_loco(self, chromosomes: list[str] = []) -> pd.DataFrame:
        self.fit()
        return self.transform_loco(chromosomes)
