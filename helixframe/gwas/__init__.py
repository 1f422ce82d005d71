"""Association tests of many phenotypes with many variants."""

from helixframe.gwas.linear import linear_regression
from helixframe.gwas.logistic import logistic_regression

__all__ = ["linear_regression", "logistic_regression"]
