"""Optimal assignment of instances to tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from habitrace.session import settled


def least_cost(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the least total cost, as many as the shorter side: augmenting paths with potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, row_of, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while row_of[j]:
            used[j] = True
            open_ = np.flatnonzero(~used[1:]) + 1
            slack = c[row_of[j] - 1, open_ - 1] - u[row_of[j]] - v[open_]
            nearer = slack < least[open_]
            least[open_[nearer]], way[open_[nearer]] = slack[nearer], j
            step = least[open_].min()
            nxt = open_[int(least[open_].argmin())]
            u[row_of[used]] += step
            v[used] -= step
            least[open_] -= step
            j = nxt
        while j:
            row_of[j], j = row_of[way[j]], way[j]
    pairs = [(int(row_of[j]) - 1, j - 1) for j in range(1, m + 1) if row_of[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def assign(instances: DataFrame, tracks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, instance_id, track_id, cost): every instance or every track of a group, whichever are fewer, is matched.

    ``instances`` (keys, instance_id, x, y), ``tracks`` (keys, track_id, x, y);
    the cost is the distance. A group is one kind of furniture in one room.
    """
    kinds = ", ".join(f"{c} {t}" for c, t in instances.select(*keys).dtypes)

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("instance_id"), right.sort_values("track_id")
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=[*keys, "instance_id", "track_id", "cost"])
        a, b = left[["x", "y"]].to_numpy(float), right[["x", "y"]].to_numpy(float)
        cost = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
        pairs = least_cost(cost)
        return pd.DataFrame([(*key, left.instance_id.iloc[i], right.track_id.iloc[j], cost[i, j]) for i, j in pairs], columns=[*keys, "instance_id", "track_id", "cost"])

    # both sides may come from one table: the second is settled, so that their columns differ
    both = instances.select(*keys, "instance_id", "x", "y").groupBy(*keys).cogroup(settled(tracks.select(*keys, "track_id", "x", "y")).groupBy(*keys))
    return both.applyInPandas(one, f"{kinds}, instance_id long, track_id long, cost double")
