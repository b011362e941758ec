"""Connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.session import discard, durable

#: Distinct edges that one task takes whole; more are worked on in rounds.
ONE_TASK = 1_000_000


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For vertices ``0 .. n - 1``, the least vertex of the component, by hooking and pointer jumping."""
    home = np.arange(n)
    while True:
        a, b = home[u], home[v]
        if (a == b).all():
            return home
        np.minimum.at(home, np.maximum(a, b), np.minimum(a, b))
        while (further := home[home]).tobytes() != home.tobytes():
            home = further


def _whole(pairs: DataFrame) -> DataFrame:
    kind = pairs.schema["u"].dataType
    schema = T.StructType([T.StructField("vertex", kind), T.StructField("component", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        ends = pa.concat_arrays([c for name in ("u", "v") for c in table.column(name).chunks])
        vertices = pc.unique(ends)
        vertices = vertices.take(pc.sort_indices(vertices))
        at = pc.index_in(ends, vertices).to_numpy()
        home = least_labels(at[: table.num_rows], at[table.num_rows :], len(vertices))
        made = pa.RecordBatch.from_arrays([vertices, vertices.take(pa.array(home))], names=["vertex", "component"])
        for start in range(0, made.num_rows, 10_000):
            yield made.slice(start, 10_000)

    return pairs.coalesce(1).mapInArrow(run, schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every vertex of ``edges`` with the smallest vertex of its component.

    Up to ``ONE_TASK`` distinct edges are labelled in one task. More go through alternating large-star
    and small-star rounds (Kiveris et al., 2014): each round links the neighbours of a
    vertex to the smallest of them, so the number of rounds grows with the logarithm of
    the longest path, and each round's result is written to the shared folder. The labels are
    the same either way. Null endpoints and self-loops are ignored. Returns ``(vertex, component)``; an empty edge table gives no rows.
    """
    a, b = F.col(src), F.col(dst)
    pairs = durable(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    if pairs.count() <= ONE_TASK:
        return _whole(pairs)
    before = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        pairs, last = durable(small), pairs
        discard(last)
        now = pairs.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "vertex")
    centres = pairs.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return stars.union(centres.join(stars, "vertex", "left_anti"))
