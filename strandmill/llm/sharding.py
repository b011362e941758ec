"""Sharding by sampled splitters.

Keys are (hash of the text, doc_id), so equal texts lie side by side; a row number tells identical
rows apart. A size-weighted sample of the keys is drawn, its weighted quantiles become splitters,
and records are range-partitioned by them. Exact sizes of the ranges show where the even cuts between
shards fall. Ranges that are overfull, or that a cut falls into, are subdivided with splitters from a
denser sample of their own, until each holds at most ``tolerance`` of a shard or one record. A shard is
then a run of whole ranges: its boundaries are splitters, and the key alone tells the shard of a record. Shards differ from even
by about the tolerance, or by a record where one is larger.

Samples hold about ``per_range`` keys a range whatever the input size; they and the table of ranges (some
thousand rows at most) are all that reaches the driver, and the table is all that is broadcast. Nulls: a null
text has size 16 and CRC 0, null ids sort first. Identical rows are interchangeable and each gets a slot of its own. An empty table
gives an empty result. Texts themselves are not shuffled by ``plan_shards``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.session import durable, table

KEY = ["h", "k", "j"]


def _weighted_quantiles(sample: pd.DataFrame, parts: int) -> pd.DataFrame:
    """At most ``parts - 1`` distinct keys that cut a sample of keys into parts of even worth."""
    sample = sample.sort_values(KEY, kind="stable").reset_index(drop=True)
    if not len(sample) or parts < 2:
        return sample[KEY].head(0)
    rank = np.cumsum(sample["worth"].to_numpy())
    at = np.searchsorted(rank, rank[-1] * np.arange(1, parts) / parts)
    return sample.loc[np.unique(np.minimum(at, len(sample) - 1)), KEY].drop_duplicates().reset_index(drop=True)


def _ranges(df: DataFrame, splitters: pd.DataFrame) -> DataFrame:
    """Number the range of each record: the count of splitters at or below its key."""
    cuts = [splitters[c].to_numpy(np.int64) for c in KEY]

    @F.pandas_udf("int")
    def place(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        m = len(cuts[0])
        for batch in batches:
            h, k, j = (np.concatenate([cut, own.to_numpy(np.int64)]) for cut, own in zip(cuts, batch, strict=True))
            # splitters before the keys that equal them
            order = np.lexsort((np.arange(len(h)) >= m, j, k, h))
            below = np.cumsum(order < m)
            out = np.empty(len(h), np.int32)
            out[order] = below
            yield pd.Series(out[m:])

    return df.withColumn("range", place(*KEY))


def plan_shards(
    df: DataFrame, key: list[str], size: str, shards: int, ranges_per_shard: int = 8, per_range: int = 64, tolerance: float = 0.001
) -> DataFrame:
    """Add ``shard`` and ``slot`` to a slim table with two bigint key columns and a positive size column.

    ``key`` names the leading and the second key column. The records should carry no long
    texts: they are written to the shared folder and shuffled once by range.
    """
    spark = df.sparkSession
    names = df.columns
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**63)))
    # written once, so that the number of a row stays what it is
    rows = durable(df.withColumns({"h": number(key[0]), "k": number(key[1]), "j": F.monotonically_increasing_id()}))
    total = rows.agg(F.sum(size)).first()[0]
    if not total:
        return df.withColumns({"shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long")})
    parts = shards * ranges_per_shard
    even = total / shards
    # a number in [0, 1) a record; records with a draw below size / step are sampled, so large ones always are
    draw = F.xxhash64(*KEY) / F.lit(2.0**64) + 0.5

    def sampled(of: DataFrame) -> pd.DataFrame:
        picked = of.where(draw * F.col("step") < F.col(size))
        return picked.select(*KEY, F.greatest(F.col(size), F.col("step")).alias("worth"), "range").toPandas()

    first = sampled(rows.withColumns({"step": F.lit(total / (parts * per_range)), "range": F.lit(0)}))
    splitters = _weighted_quantiles(first, parts)
    while True:
        placed = _ranges(rows, splitters)
        sizes = placed.groupBy("range").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).toPandas().sort_values("range").reset_index(drop=True)
        after = sizes["bytes"].cumsum()
        sizes["before"] = after - sizes["bytes"]
        cut = np.floor(sizes["before"] / even) < np.ceil(after / even) - 1
        wide = (cut & (sizes["bytes"] > tolerance * even)) | (sizes["bytes"] > 4 * total / parts)
        wide = sizes[wide & (sizes["rows"] > 1)]
        if not len(wide):
            break
        steps = spark.createDataFrame(wide[["range"]].assign(step=wide["bytes"] / per_range), "range int, step double")
        finer = sampled(placed.join(F.broadcast(steps), "range"))
        more = [_weighted_quantiles(own, per_range // 4) for _, own in finer.groupby("range")]
        found = pd.concat([splitters, *more]).drop_duplicates().sort_values(KEY).reset_index(drop=True)
        if len(found) == len(splitters):
            break
        splitters = found

    # a range belongs where its middle falls, so that shards are runs of ranges
    middle = sizes["before"] + sizes["bytes"] / 2
    sizes["shard"] = np.minimum(np.floor(middle / even), shards - 1).astype(int)
    sizes["slots"] = sizes.groupby("shard")["rows"].cumsum() - sizes["rows"]
    starts = spark.createDataFrame(sizes[["range", "shard", "slots"]].astype("int64"), "range int, shard int, slots long")
    inside = Window.partitionBy("range").orderBy(*KEY)
    ordered = placed.join(F.broadcast(starts), "range").withColumn("slot", F.col("slots") + F.row_number().over(inside) - 1)
    return ordered.select(*names, "shard", "slot")


def shard_records(df: DataFrame, shards: int, id_col: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for every row; size is the UTF-8 length plus ``overhead``."""
    slim = df.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    return plan_shards(slim, ["text_hash", id_col], "size", shards)


def write_shards(df: DataFrame, path: str, shards: int, id_col: str = "doc_id", text: str = "text") -> None:
    """Write the records themselves as one folder a shard, in slot order; ``id_col`` must be unique."""
    plan = shard_records(df, shards, id_col, text).select(id_col, "shard", "slot")
    (
        df.join(plan, id_col)
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes, by the law ``bytes``."""
    found = shard_records(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
