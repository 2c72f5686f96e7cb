"""Sum-of-squares packing of items into containers of fixed capacity.

An item goes into the open container, or a new one, for which the sum over all
gaps of the squared number of open containers with that gap becomes smallest:
this keeps the gaps spread, so later items find a container they fill exactly.
An item larger than the capacity is cut into full containers and one rest,
which is packed like any other item; no other item is ever split.

The items are dealt by hash into groups of a bounded number of rows; a group is
packed by one task, and the few containers it leaves badly filled are taken
apart and packed again together with those of other groups, in rounds, until
one group is left or a round leaves more than STALLED of what it was given. So
nothing grows with the data but the number of groups.

Defined cases: null key, null size and sizes of 0 or less need no container;
repeated rows count once; equal gaps: the smallest gap wins; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.session import cut, forget

#: Rows of a group, the fill below which a group's containers are taken apart again, and the part of the rows left by a round at which more rounds are no use.
GROUP, FULL, STALLED = 20_000, 0.97, 0.9


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each size, in the order given; every size is from 1 to capacity."""
    count = np.zeros(capacity + 1, np.int64)  # open containers by gap; 0, a full one, never counts
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, made = np.empty(len(sizes), np.int64), 0
    huge = np.iinfo(np.int64).max
    for k, s in enumerate(sizes):
        here, after = count[s:], count[: capacity + 1 - s]
        cost = np.where(here > 0, 2 * (after - here) + 2, huge)
        if here[0] > 0:
            cost[0] = 1 - 2 * here[0]
        new = 2 * count[capacity - s] + 1 if s < capacity else 0
        best = int(cost.argmin())
        if cost[best] <= new and cost[best] != huge:
            gap = s + best
            number = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, number, made = capacity, made, made + 1
        rest = gap - s
        if rest:
            open_at[rest].append(number)
            count[rest] += 1
        out[k] = number
    return out


def pieces(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """key, part, n: items cut where they exceed the capacity."""
    one = items.where(F.col(key).isNotNull() & (F.col(size) > 0)).select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("size")).distinct()
    last = F.floor((F.col("size") - 1) / capacity).cast("int")
    return one.withColumn("part", F.explode(F.sequence(F.lit(0), last))).select("key", "size", "part", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("part") * F.lit(capacity)).alias("n"))


def _placer(capacity: int, turn: int):
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "key", "size", "part"], kind="stable")
        sizes = pdf["n"].to_numpy(np.int64)
        at = sum_of_squares(sizes, capacity)
        used = np.bincount(at, weights=sizes).astype(np.int64)
        names = [f"{turn}-{g}-{b}" for g, b in zip(pdf["g"], at)]
        return pd.DataFrame({"key": list(pdf["key"]), "size": pdf["size"].to_numpy(), "part": pdf["part"].to_numpy(), "n": sizes, "container_id": names, "used": used[at]})

    return place


def pack(items: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens", group: int = GROUP) -> DataFrame:
    """(key, part int, n_tokens bigint, container_id string): every item, or part of a large one, in its container."""
    if capacity < 1 or group < 1:
        raise ValueError("capacity and group must be positive")
    kind = items.schema[key].dataType.simpleString()
    schema = f"key {kind}, size bigint, part int, n bigint, container_id string, used bigint"
    left, done, before, turn = cut(pieces(items, key, size, capacity)), [], math.inf, 0
    while True:
        rows = left.count()
        groups = max(1, math.ceil(rows / group))
        h = F.xxhash64("key", "size", "part", F.lit(turn))
        # Later rounds see the larger pieces first, which leaves small ones to fill the gaps.
        order = h if turn == 0 else -F.col("n")
        dealt = left.withColumns({"g": F.pmod(h, F.lit(groups)), "order": order})
        placed = cut(dealt.groupBy("g").applyInPandas(_placer(capacity, turn), schema))
        forget(left)
        if groups == 1 and turn > 0 or rows == 0 or rows > STALLED * before:
            done.append(placed)
            break
        done.append(placed.where(F.col("used") >= FULL * capacity))
        left = cut(placed.where(F.col("used") < FULL * capacity).select("key", "size", "part", "n"))
        before, turn = rows, turn + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("key").alias(key), "part", F.col("n").alias("n_tokens"), "container_id")
