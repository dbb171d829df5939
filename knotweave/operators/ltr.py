"""Learning to rank: leave-one-query-out logistic regression over candidate features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS, RATE, RIDGE = 300, 0.3, 1e-3


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Weights and intercept by gradient descent on the mean loss; the intercept has no penalty."""
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        w, b = w - rate * (x.T @ error / len(y) + ridge * w), b - rate * error.mean()
    return w, b


def leave_one_out(rows: DataFrame, features: list[str]) -> DataFrame:
    """``query_id rank``: where a query's target lands under weights learned from all others.

    ``rows``: query_id id label and the features; one fold for each query. Folds
    run in parallel. The gold set that folds share is judged by hand and must
    not exceed a million rows: it is broadcast, and its size is checked.
    """
    n = rows.count()
    if n > 1_000_000:
        raise ValueError("gold rows beyond a million do not fit every fold's memory")
    gold = rows.select("query_id", "id", "label", *features).toPandas()
    x, y, q = gold[features].to_numpy(float), gold["label"].to_numpy(float), gold["query_id"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast((x, y, q, gold["id"].to_numpy()))

    def fold(batches):
        x, y, q, ids = shared.value
        for batch in batches:
            out = []
            for query in batch["query_id"]:
                held = q == query
                if held.all():
                    out.append((query, None))
                    continue
                w, b = fit_logistic(x[~held], y[~held])
                order = np.lexsort((ids[held], -(x[held] @ w + b)))
                hit = np.flatnonzero(y[held][order] == 1)
                out.append((query, int(hit[0]) + 1 if len(hit) else None))
            yield pd.DataFrame(out, columns=["query_id", "rank"]).astype({"rank": "Int32"})

    kind = rows.schema["query_id"].dataType.simpleString()
    return rows.select("query_id").distinct().repartition("query_id").mapInPandas(fold, f"query_id {kind}, rank int")


def features(pool: DataFrame, columns: list[str], by: str = "query_id") -> DataFrame:
    """Candidate features, each min-maxed within its query."""
    from pyspark.sql import Window

    from .fusion import minmax

    own = Window.partitionBy(by)
    return pool.withColumns({c: minmax(F.coalesce(F.col(c), F.lit(0.0)), own) for c in columns})
