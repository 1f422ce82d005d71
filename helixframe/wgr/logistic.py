"""The last level for binary labels: one Newton step from leave-out pieces of logistic ridge fits, chosen by log loss."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.stats.regression import sigmoid
from helixframe.wgr import base, ridge
from helixframe.wgr.regression import KEYS, LastLevel

PIECES = "sample_block string, label string, alpha string, headers array<string>, sort_keys array<int>, beta binary, xtgx binary, xty binary"
EPS = 1e-15


def constrained_fit(x: np.ndarray, y: np.ndarray, penalty: np.ndarray, start: np.ndarray, frozen: int, rounds: int = 100) -> np.ndarray:
    """Coefficients of a ridge logistic fit whose first ones stay as they are, by damped Newton steps."""
    b, free = start.astype(float).copy(), slice(frozen, None)

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((np.logaddexp(0, z) - y * z).sum() + (penalty * b * b).sum() / 2)

    now = loss(b)
    for _ in range(rounds):
        p = sigmoid(x @ b)
        gradient = (x.T @ (p - y) + penalty * b)[free]
        if np.abs(gradient).max(initial=0) < 1e-9 * len(y):
            break
        hessian = x[:, free].T @ (x[:, free] * (p * (1 - p))[:, None]) + np.diag(penalty[free])
        step = np.zeros(len(b))
        step[free] = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        size = 1.0
        while size > 1e-6 and not loss(b - size * step) <= now:
            size /= 2
        b, before = b - size * step, now
        now = loss(b)
        if before - now <= 1e-14 * (abs(now) + 1):
            break
    return b


class LogisticRidgeRegression(LastLevel):
    metric = "log_loss"

    def __init__(self, reduced_block_df: DataFrame, label_df: pd.DataFrame, sample_blocks: dict[str, list[str]], cov_df: pd.DataFrame = pd.DataFrame({}), add_intercept: bool = True, alphas: list[float] = [], label_type: str = "binary") -> None:
        super().__init__(reduced_block_df, label_df, sample_blocks, cov_df, add_intercept, alphas, "binary")

    @staticmethod
    def score(xb: np.ndarray, y: np.ndarray) -> np.ndarray:
        p = sigmoid(xb)
        return -(y * np.log(p + EPS) + (1 - y) * np.log(1 - p + EPS)).mean(0)

    def covariate_effects(self) -> dict[str, np.ndarray]:
        """Per label the covariates' coefficients over all samples."""
        c = self.std_covariates.to_numpy(float)
        out = {}
        for name in self.label_df:
            y = self.label_df[name].to_numpy(float)
            known = ~np.isnan(y)
            out[str(name)] = constrained_fit(c[known], y[known], np.zeros(c.shape[1]), np.zeros(c.shape[1]), 0) if c.size else np.zeros(0)
        return out

    def fit(self) -> tuple[DataFrame, DataFrame]:
        shared, alphas = self.shared(self.label_df), self.alphas
        effects = self.blocks.sparkSession.sparkContext.broadcast(self.covariate_effects())
        keys = [*KEYS, "alpha"]

        def pieces(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            labels, covariates, samples = shared.value
            sample_block, label, alpha = key
            pdf, fixed = base.ordered(pdf), effects.value[label]
            x = ridge.design(pdf, covariates, samples[sample_block])
            y = ridge.of_label(labels, label).loc[samples[sample_block]].to_numpy(float)[:, 0]
            x, y = x[~np.isnan(y)], y[~np.isnan(y)]
            n = len(fixed)
            b = np.concatenate([fixed, np.zeros(x.shape[1] - n)])
            if y.sum() > 0:  # a block without cases keeps the covariates' effects only
                b = constrained_fit(x, y, np.concatenate([np.zeros(n), np.full(x.shape[1] - n, alphas[alpha])]), b, n)
            p = sigmoid(x @ b)
            headers, sort_keys = [*map(str, covariates.columns[:n]), *pdf["header"]], [*range(-n, 0), *map(int, pdf["sort_key"])]
            row = (sample_block, label, alpha, headers, sort_keys, b.tobytes(), ((x.T * (p * (1 - p))) @ x).tobytes(), (x.T @ (p - y)).tobytes())
            return pd.DataFrame([row], columns=[f.split()[0] for f in PIECES.split(", ")])

        def solve(parts):
            n = shared.value[1].shape[1]
            for pdf in parts:
                for r in pdf.itertuples(index=False):
                    side, others = len(r.headers), r.blocks - 1
                    less = lambda c: np.frombuffer(getattr(r, f"total_{c}")) - np.frombuffer(getattr(r, c))  # noqa: B023, E731
                    mean, left, right = less("beta") / others, less("xtgx").reshape(side, side)[n:, n:], less("xty")[n:]
                    b = mean.copy()
                    b[n:] -= np.linalg.solve(left + alphas[r.alpha] * np.eye(side - n), right + alphas[r.alpha] * mean[n:])
                    yield pd.DataFrame([(r.sample_block, r.label, r.alpha, r.headers, r.sort_keys, b.tobytes())], columns=["sample_block", "label", "alpha", "headers", "sort_keys", "b"])

        def together(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            sample_block, label = key
            pdf = pdf.sort_values("alpha")
            names, first = list(pdf["alpha"]), pdf.iloc[0]
            b = np.column_stack([np.frombuffer(v) for v in pdf["b"]])
            return pd.DataFrame({"header_block": "all", "sample_block": sample_block, "label": label, "header": list(first["headers"]), "sort_key": np.asarray(first["sort_keys"], np.int32), "alphas": [names] * len(b), "labels": [[label] * len(names)] * len(b), "coefficients": list(b)})

        each = self.blocks.drop("alpha").withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
        beside = ridge.beside_totals(each.groupBy(*keys).applyInPandas(pieces, PIECES), ["label", "alpha"], ["beta", "xtgx", "xty"], keys)
        steps = beside.mapInPandas(solve, "sample_block string, label string, alpha string, headers array<string>, sort_keys array<int>, b binary")
        self.model_df = steps.groupBy("sample_block", "label").applyInPandas(together, base.MODEL_SCHEMA)  # a row for each penalty
        self.cv_df = base.best_alphas(self.scored(self.label_df), alphas, self.metric)
        return self.model_df, self.cv_df

    def _finish(self, response: str):
        if response not in ("linear", "sigmoid"):
            raise ValueError(f'response must be either "linear" or "sigmoid", received "{response}"')
        return sigmoid if response == "sigmoid" else np.asarray

    def transform(self, response: str = "linear") -> pd.DataFrame:
        """Predictions: linear without covariates, or sigmoid probabilities with them."""
        return self.shaped(self.predicted([""], response == "sigmoid", self._finish(response)), False)

    def transform_loco(self, response: str = "linear", chromosomes: list[str] = []) -> pd.DataFrame:
        return self.shaped(self.predicted(self.chromosomes(chromosomes), response == "sigmoid", self._finish(response)), True)

    def fit_transform(self, response: str = "linear") -> pd.DataFrame:
        self.fit()
        return self.transform(response)

    def fit_transform_loco(self, response: str = "linear", chromosomes: list[str] = []) -> pd.DataFrame:
        self.fit()
        return self.transform_loco(response, chromosomes)
