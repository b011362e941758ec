"""Mixing sources to target weights by entropy balancing.

Document rates minimise their entropy relative to one copy each, under one token constraint
for each source and a ceiling. The solution tilts exponentially, ``rate = min(ceiling,
exp(lambda[source] * size / scale))``, and the convex dual is solved by Newton steps kept
inside a bracket. Each step is one distributed aggregation; the rate depends on source and
size alone, so it runs over counts of those pairs. Rates become
copies by a threshold: a document takes the whole part of its rate, and one copy more if a
hash of the document, less the fractional part, lies below its source's threshold. Two
refinements of a histogram find the threshold that brings the source's tokens to the target
from below, and the largest documents that still fit fill what is left.

Only DataFrame operations are used. Sums are exact (integers and decimals), so reruns agree.
Tables of one row a source are joined without hints, so Spark broadcasts them only below its
own size limit. Ranks of sources are taken in one task over one row a source.

Nulls: a null source is a source of its own, ranked last; a null text has size 0; null ids
hash as such. Identical rows share a hash and so cross the threshold together; what that
leaves is filled like the rest. A source of no tokens has target 0. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.session import durable, ship, table

#: Rates and hashes are held as integers of this unit.
UNIT = 10**9
BINS = 2048


def words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: list[float], share: float, ceiling: int) -> DataFrame:
    """Give each row of ``(source, source_size)`` its target.

    Weights repeat over the sources in code-point order, null last. A target stops at
    ``ceiling`` times its source's size and the excess is shared out again by weight, which
    is one water level: the smallest prefix of sources, by size over weight, that stops.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    every = Window.partitionBy()
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    )
    stops = F.col("cap") <= F.col("weight") * level
    rated = weighed.withColumns({"level": level, "stops": stops, "place": F.row_number().over(by_fill)})
    water = F.min(F.when(~F.col("stops"), F.struct("place", "level"))).over(every)["level"]
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * water, F.col("cap")))
    return rated.withColumn("target", target).select("source", "source_size", "target")


def _rate(ceiling: int) -> Column:
    """The tilted rate in units; ``full`` sources take every document as often as allowed."""
    tilted = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(math.log(ceiling) + 1)))
    whole = F.least(F.round(tilted * UNIT), F.lit(float(ceiling * UNIT))).cast("long")
    return F.when(F.col("full"), F.lit(ceiling * UNIT)).when(F.col("target") <= 0, F.lit(0)).otherwise(whole)


def _newton(cells: DataFrame, state: DataFrame, ceiling: int, steps: int, near: float) -> DataFrame:
    """Solve the dual for every source at once; ``state`` has a row a source."""
    spark = cells.sparkSession
    state = durable(state)
    for _ in range(steps):
        rated = cells.join(state, cells["source"].eqNullSafe(state["source"])).drop(cells["source"])
        rate = _rate(ceiling)
        tokens = F.col("rows").cast("decimal(18,0)") * F.col("size").cast("decimal(10,0)")
        slope = F.when(rate < ceiling * UNIT, tokens * (F.col("size").cast("decimal(10,0)") * rate.cast("decimal(10,0)")))
        sums = rated.groupBy("source").agg(
            F.sum(tokens * rate.cast("decimal(10,0)")).cast("double").alias("now"), F.sum(slope).cast("double").alias("slope")
        )
        sums = sums.withColumns({"now": F.col("now") / UNIT, "slope": F.coalesce(F.col("slope"), F.lit(0.0)) / UNIT})
        moved = state.join(sums.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        moved = moved.withColumn("low", F.when(F.col("now") < F.col("target"), F.col("tilt")).otherwise(F.col("low")))
        moved = moved.withColumn("high", F.when(F.col("now") >= F.col("target"), F.col("tilt")).otherwise(F.col("high")))
        step = F.col("tilt") + F.when(F.col("slope") > 0, (F.col("target") - F.col("now")) * F.col("scale") / F.col("slope"))
        inside = (step > F.col("low")) & (step < F.col("high"))
        close = F.abs(F.col("target") - F.col("now")) <= near * F.col("target")
        settled = F.col("full") | (F.col("target") <= 0) | F.coalesce(close, F.lit(True))
        # rounding keeps the tilt free of the last bits, which may depend on the order of sums
        tilt = F.round(F.when(inside, step).otherwise((F.col("low") + F.col("high")) / 2), 9)
        moved = moved.withColumns({"settled": settled, "tilt": F.when(settled, F.col("tilt")).otherwise(tilt)})
        state = durable(moved.drop("now", "slope"))
        if not state.where(~F.col("settled")).limit(1).count():
            break
    else:
        # the threshold that follows still brings such sources to their target
        warnings.warn(f"{state.where(~F.col('settled')).count()} sources were not balanced to {near} in {steps} steps", stacklevel=2)
    return state


def mixture(rows: DataFrame, goals: DataFrame, ceiling: int = 2, steps: int = 40, near: float = 1e-4, fills: int = 3) -> DataFrame:
    """State of each source from which ``copies`` follow: tilt, threshold and documents that fill the rest.

    ``rows`` has ``source, size, mark`` (a 64-bit hash of the document); ``goals`` is the result of ``targets``.
    """
    cells = durable(rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("rows")))
    ends = cells.groupBy("source").agg(F.max("size").alias("scale"), F.min("size").alias("least"))
    state = goals.join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    share = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    bound = F.col("scale") / F.col("least")
    state = state.withColumns(
        {
            "full": F.coalesce(F.col("target") >= F.col("source_size") * F.lit(float(ceiling)), F.lit(True)),
            "low": F.when(share < 1, F.log(F.coalesce(share, F.lit(1.0))) * bound).otherwise(F.lit(0.0)) - 1,
            "high": F.when(share > 1, math.log(ceiling) * bound).otherwise(F.lit(0.0)) + 1,
            "tilt": F.lit(0.0),
            "settled": F.lit(False),
        }
    )
    state = _newton(cells, state, ceiling, steps, near).select("source", "source_size", "target", "scale", "full", "tilt")
    state = state.withColumns({"cut": F.lit(-UNIT), "width": F.lit(BINS * BINS), "room": F.lit(None).cast("long")})
    rated = durable(_join(rows, state).withColumn("rate", _rate(ceiling)).select("source", "size", "mark", "rate", *_lot()))
    base = rated.groupBy("source").agg(F.sum(F.col("size") * F.floor(F.col("rate") / UNIT)).alias("whole"))
    state = _join(state, base, "left").withColumn("room", F.floor("target") - F.coalesce(F.col("whole"), F.lit(0))).drop("whole")
    state = durable(state)
    step = BINS * BINS
    while step >= 1:
        bins = _join(rated, state.select("source", "cut")).where(F.col("lot") >= F.col("cut"))
        bins = bins.withColumn("bin", F.least(F.floor((F.col("lot") - F.col("cut")) / step), F.lit(BINS)))
        bins = bins.where(F.col("bin") < BINS).groupBy("source", "bin").agg(F.sum("size").alias("tokens"))
        running = Window.partitionBy("source").orderBy("bin")
        bins = _join(bins, state.select("source", "room")).withColumn("sum", F.sum("tokens").over(running))
        over = bins.groupBy("source").agg(
            F.min(F.when(F.col("sum") > F.col("room"), F.col("bin"))).alias("bin"),
            F.max(F.when(F.col("sum") <= F.col("room"), F.col("sum"))).alias("taken"),
        )
        state = _join(state, over, "left").withColumns(
            {
                "cut": F.col("cut") + F.coalesce(F.col("bin"), F.lit(BINS)) * step,
                "room": F.col("room") - F.coalesce(F.col("taken"), F.lit(0)),
            }
        )
        state = durable(state.drop("bin", "taken"))
        step //= BINS
    state = state.withColumn("extra", F.array().cast("array<bigint>"))
    for _ in range(fills):
        taken = _join(rated, state.select("source", "cut", "room", "extra"))
        one = F.when(F.col("lot") < F.col("cut"), 1).otherwise(0)
        fits = (F.col("size") <= F.col("room")) & (F.col("size") > 0) & ~F.array_contains("extra", F.col("mark"))
        free = taken.where(fits & (F.floor(F.col("rate") / UNIT) + one < ceiling))
        # rows with one mark go in together, so they must fit together
        free = free.groupBy("source", "mark", "room").agg(F.sum("size").alias("all")).where("all <= room")
        best = free.groupBy("source").agg(F.max(F.struct("all", "mark")).alias("best"))
        state = _join(state, best, "left").withColumns(
            {
                "extra": F.when(F.col("best").isNull(), F.col("extra")).otherwise(F.array_append("extra", F.col("best.mark"))),
                "room": F.col("room") - F.coalesce(F.col("best.all"), F.lit(0)),
            }
        )
        state = durable(state.drop("best"))
    return state.select("source", "source_size", "target", "scale", "full", "tilt", "cut", "extra")


def _lot() -> list[Column]:
    """Hash of the document in units, less the fractional part of its rate; full rates have no extra copy."""
    drawn = F.pmod(F.col("mark"), F.lit(UNIT))
    return [F.when(F.col("rate") % UNIT == 0, F.lit(3 * UNIT)).otherwise(drawn - F.col("rate") % UNIT).alias("lot")]


def _join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, left["source"].eqNullSafe(right["_source"]), how).drop("_source")


def copies(rows: DataFrame, state: DataFrame, ceiling: int = 2) -> DataFrame:
    """Add ``source_size, target, rate`` and ``copies`` to rows with ``source, size, mark``."""
    found = _join(rows, state).withColumn("rate", _rate(ceiling))
    found = found.withColumns({"lot": _lot()[0]})
    more = (F.col("lot") < F.col("cut")).cast("int") + F.array_contains("extra", F.col("mark")).cast("int")
    found = found.withColumn("copies", (F.floor(F.col("rate") / UNIT) + more).cast("int"))
    return found.withColumn("rate", F.col("rate") / UNIT).drop("scale", "full", "tilt", "cut", "extra", "lot")


def marked(df: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The columns that the mixture needs, beside those of ``df``."""
    return df.select("*", F.col(source).alias("_s"), words(F.col(text)).alias("_n"), F.xxhash64(id_col, source, text).alias("_m"))


def mix(df: DataFrame, weights: list[float], share: float = 1.5, ceiling: int = 2) -> DataFrame:
    """``doc_id`` of every row with its size, its source's size and target, its rate and copies."""
    rows = marked(df.select("doc_id", "source", "text"))
    rows = durable(rows.select("doc_id", "source", F.col("_n").alias("size"), F.col("_m").alias("mark")))
    sources = durable(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    state = mixture(rows, targets(sources, weights, share, ceiling), ceiling)
    return copies(rows, state, ceiling)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mixture takes of each, for weights 5, 2, 1 and a share of 150%."""
    found = mix(table(spark, sf_dir, "documents"), [5, 2, 1])
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mix_documents(docs: DataFrame, weights: list[float], share: float, ceiling: int = 2) -> DataFrame:
    """The documents themselves, each as often as the mixture takes it, with the columns of ``docs``."""
    ship(docs.sparkSession)
    row = docs.select(F.struct(*docs.columns).alias("_row"))
    mark = F.xxhash64(*(F.col(f"_row.{c}") for c in ("doc_id", "source", "text")))
    whole = row.select("_row", F.col("_row.source").alias("source"), words(F.col("_row.text")).alias("size"), mark.alias("mark"))
    rows = durable(whole.drop("_row"))
    sources = durable(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    state = mixture(rows, targets(sources, weights, share, ceiling), ceiling)
    taken = copies(whole, state, ceiling).where("copies > 0")
    taken = taken.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_copy"))
    return taken.select("_row.*")
