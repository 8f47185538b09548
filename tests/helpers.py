"""Small helpers shared by the tests."""

from __future__ import annotations

import numpy as np

SF = "/root/testdata/sf0.01"


def training_rows(spark, sf=SF):
    from svmflow.plans.fixtures import training_samples

    return training_samples(spark, sf)


def to_matrix(rows, dims=2):
    x = np.zeros((len(rows), dims))
    for r, row in enumerate(rows):
        for f in row["features"]:
            x[r, f["idx"] - 1] = f["val"]
    return x


def rbf(a, b, gamma):
    return np.exp(-gamma * ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
