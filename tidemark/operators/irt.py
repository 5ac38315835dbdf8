"""Graded-response items: category probabilities, information, trait estimates, held-out scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def category_probabilities(z: Column, discrimination: float, thresholds: list[float], floor: float = 1e-12) -> Column:
    """Probabilities of an item's categories at trait z: differences of neighbouring logistic curves, at least floor."""
    above = [F.lit(1.0), *(_logistic(discrimination * (z - b)) for b in thresholds), F.lit(0.0)]
    return F.array(*(F.greatest(a - b, F.lit(floor)) for a, b in zip(above[:-1], above[1:], strict=True)))


def log_likelihood(z: Column, items: list[Column], spec: list[tuple[float, list[float]]]) -> Column:
    """Sum over observed items (null is unobserved) of the log probability of the category that was given."""
    parts = [F.coalesce(F.log(F.element_at(category_probabilities(z, a, b), x.cast("int") + 1)), F.lit(0.0)) for x, (a, b) in zip(items, spec, strict=True)]
    return sum(parts[1:], parts[0])


def expected_total(z: Column, spec: list[tuple[float, list[float]]]) -> Column:
    """Expected sum of the items' scores."""
    parts = [_logistic(a * (z - t)) for a, b in spec for t in b]
    return sum(parts[1:], parts[0])


def score_and_information(z: np.ndarray, items: np.ndarray, spec: list[tuple[float, list[float]]]) -> tuple[np.ndarray, np.ndarray]:
    """First derivative of the log likelihood and Fisher information at z, over rows of items (negative: unobserved)."""
    score, information = np.zeros(len(z)), np.zeros(len(z))
    for k, (a, b) in enumerate(spec):
        cum = np.concatenate([np.ones((len(z), 1)), 1 / (1 + np.exp(-a * (z[:, None] - np.array(b)))), np.zeros((len(z), 1))], axis=1)
        slope = a * cum * (1 - cum)
        p, d = np.maximum(cum[:, :-1] - cum[:, 1:], 1e-12), slope[:, :-1] - slope[:, 1:]
        seen = items[:, k] >= 0
        own = np.where(seen, items[:, k], 0)
        at = np.arange(len(z))
        score += np.where(seen, d[at, own] / p[at, own], 0)
        information += np.where(seen, (d * d / p).sum(axis=1), 0)
    return score, information


def trait_estimates(df: DataFrame, items: str, spec: list[tuple[float, list[float]]], steps: int = 6, location: float = 0.0, scale: float = 1.0) -> DataFrame:
    """df with trait, information, target and target_sd: Fisher scoring whose steps divide by one more than the information, clipped to +-4.

    items holds one number for each item of spec, null where it was not given, and is itself not null. target and target_sd are the pseudo-observation on the raw scale. Batches are worked on as whole arrays.
    """
    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + ", trait double, information double, target double, target_sd double"

    def run(batches):
        for batch in batches:
            rows = np.array(pc.fill_null(batch.column(items).flatten(), -1), np.int64).reshape(batch.num_rows, len(spec))
            z = np.zeros(batch.num_rows)
            for _ in range(steps):
                score, information = score_and_information(z, rows, spec)
                z = np.clip(z + score / (information + 1), -4, 4)
            information = score_and_information(z, rows, spec)[1]
            out = [pa.array(x) for x in (z, information, z * scale + location, scale / np.sqrt(information + 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "trait", "information", "target", "target_sd"])

    return df.mapInArrow(run, schema)
