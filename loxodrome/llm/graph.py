"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, written


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the same components as the edges: each node but the least of its component with that one."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    top = np.arange(len(nodes))
    while True:
        low = np.minimum(top[x], top[y])
        new = top.copy()
        for ends in (x, y):
            np.minimum.at(new, ends, low)
            np.minimum.at(new, top[ends], low)
        new = new[new]
        if (new == top).all():
            break
        top = new
    rest = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[rest], nodes[top[rest]]


#: Edges that a task holds at a time while it contracts them.
HELD = 1_000_000


def _contracted(edges: DataFrame, most: int) -> DataFrame:
    """The edges (a, b) of each partition made stars, `most` at a time; never more than before."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        room = most
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            room -= batch.num_rows
            if room <= 0:
                a, b = contracted(*map(np.concatenate, zip(*held, strict=True)))
                held, room = [(a, b)], most - len(a)
                if room < most // 2:
                    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                    held, room = [], most
        if held:
            a, b = contracted(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def _forest(edges: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """A written table of fewer edges with the same components as the table `edges`, and whether it is settled.

    Each pass deals `most` edges to a task and stops where one spares less than half of them; what a single task has held is settled.
    """
    now, last = edges.where("a <> b").select("a", "b"), None
    n = now.count()
    while True:
        tasks, counted = n // most + 1, Observation()
        now = written(_contracted(now.coalesce(tasks), most).observe(counted, F.count("*").alias("n")))
        if last is not None:
            discard(last)
        before, n, last = n, counted.get["n"], now
        if tasks == 1 or 2 * n >= before:
            return now, tasks == 1


def _named(stars: DataFrame) -> DataFrame:
    """(node, component) of stars."""
    node, top = F.col("a"), F.col("b").alias("component")
    return stars.select(node.alias("node"), top).unionAll(stars.select(F.col("b").alias("node"), top).distinct())


def components(edges: DataFrame, most_rounds: int = 60, most: int = HELD) -> DataFrame:
    """(node, component) of all nodes of the table `edges` (a, b); a component's name is its least node.

    The edges are first made a forest, at most `most` of them in a task at a time, in as many tasks as they need. What that leaves in many
    tasks goes through large-star and small-star steps: each node's neighbours are hung on its least neighbour, first
    the larger ones and then the smaller ones, until every node hangs on its component's least node. Every round is written to
    the shared folder, with the edges of each task contracted to stars, which saves rounds and leaves settled stars as they are. Least
    neighbours are combined before the shuffle, and a hub's edges make a skewed join, split at run time.
    """
    a, b = F.col("a"), F.col("b")
    now, settled = _forest(edges, most)
    if settled:
        return _named(now)
    before = None
    for _ in range(most_rounds):
        both = now.select("a", "b").unionAll(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(b.alias("x"), a, F.col("m"))
        hung = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        counted = Observation()
        sums = F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
        last, now = now, written(_contracted(hung, most).observe(counted, F.count("*").alias("n"), sums.alias("h")))
        discard(last)
        seen = counted.get
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return _named(now)
