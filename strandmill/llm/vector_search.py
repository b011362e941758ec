"""Nearest neighbours by score-aware quantisation.

Unit vectors are cut into subspaces of two dimensions with 16 centres each, so a code takes
four bits a subspace. Centres and codes minimise an anisotropic loss (Guo et al., 2020):
the part of a residual that is parallel to its vector costs ``eta`` times the
orthogonal part, because it is what changes large inner products. Centres are fitted on a
bounded sample (``sample_rows`` rows with the least hashes); every row is coded once, and
the codes (32 bytes for 64 dimensions) are stored in the index.

What a code leaves of its row is stored beside it, in two bytes a component by the row's own scale, with the lengths
of what the code leaves and of what both leave. So a distance from a unit vector is known from either within a stated length.

The scan reads the index alone: rows are dealt to blocks by hash, queries go to every block,
and a task holds the index of one block of rows and one block of queries. Two codes share a byte, so a
query scans a table of 256 scores for each byte. The best ``rerank`` rows of each block are refined by what codes leave and
bound the ``k``-th distance; then every other row that its code can't tell to be farther is refined as well, and those that may
still be among the ``k`` nearest are joined to the stored vectors and scored again exactly, in double precision. None is
lost, whatever the vectors: how near they lie to each other decides how many are scored, not which are found. Full vectors
move once to find copies, and then only for queries and candidates. Copies of a vector are one row of the index, with as many of the least ids as can be found.

Nulls: rows whose vector is null, zero, or holds null or non-finite components take no part,
neither as queries nor as candidates. A cosine needs equal lengths, so each length is an index of its own, and
a query's candidates are the rows of its length. A null id is no query. Ties go to the smaller id; repeated ids are
separate candidates and separate queries, and a query skips rows of its own id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.session import durable, table

CENTRES = 16
STEPS = 32_767


class Quantiser:
    """Codebooks ``(subspaces, 16, width)`` fitted under the anisotropic loss."""

    def __init__(self, books: np.ndarray, eta: float):
        self.books, self.eta = books, eta

    @classmethod
    def fit(cls, x: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 8, seed: int = 7) -> Quantiser:
        d = x.shape[1]
        spaces = -(-d // width)
        x = np.pad(x, ((0, 0), (0, spaces * width - d)))
        eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
        rng = np.random.default_rng(seed)
        books = np.stack([x[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES), m * width : (m + 1) * width] for m in range(spaces)])
        own = cls(books + rng.normal(0, 1e-6, books.shape), 1.0)
        for r in range(2 * rounds):
            # plain clustering first, then the anisotropic loss from where it ended
            own.eta = 1.0 if r < rounds else eta
            own._update(x, own._codes(x))
        return own

    def _parts(self, x: np.ndarray) -> np.ndarray:
        spaces, _, width = self.books.shape
        x = np.pad(x, ((0, 0), (0, spaces * width - x.shape[1])))
        return x.reshape(len(x), spaces, width)

    def _codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Coordinate descent over subspaces; a code's cost includes the parallel residual of all others."""
        parts = self._parts(x)
        near = np.stack([((parts[:, m, None] - self.books[m]) ** 2).sum(-1) for m in range(parts.shape[1])], 1)
        along = np.stack([(parts[:, m] ** 2).sum(-1)[:, None] - parts[:, m] @ self.books[m].T for m in range(parts.shape[1])], 1)
        codes = near.argmin(-1)
        if self.eta > 1:
            rows = np.arange(len(parts))
            total = np.take_along_axis(along, codes[..., None], 2)[..., 0].sum(1)
            for _ in range(sweeps):
                for m in range(parts.shape[1]):
                    rest = total - along[rows, m, codes[:, m]]
                    codes[:, m] = (near[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(-1)
                    total = rest + along[rows, m, codes[:, m]]
        return codes

    def _update(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Each centre solves the normal equations of the loss over its members."""
        parts = self._parts(x)
        rows = np.arange(len(parts))
        width = parts.shape[2]
        residual = np.stack([(parts[:, m] * (parts[:, m] - self.books[m][codes[:, m]])).sum(-1) for m in range(parts.shape[1])], 1)
        total = residual.sum(1)
        for m in range(parts.shape[1]):
            p, rest = parts[:, m], total - residual[:, m]
            for c in range(CENTRES):
                own = rows[codes[:, m] == c]
                if not len(own):
                    continue
                v = p[own]
                a = len(own) * np.eye(width) + (self.eta - 1) * v.T @ v
                b = (v * (1 + (self.eta - 1) * (rest[own] + (v**2).sum(-1)))[:, None]).sum(0)
                self.books[m, c] = np.linalg.solve(a, b)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Two four-bit codes a byte."""
        codes = self._codes(x)
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def scores(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate inner products ``(queries, rows)`` by table look-ups."""
        parts = self._parts(queries)
        tables = np.einsum("qmw,mcw->qmc", parts, self.books).astype(np.float32)
        if tables.shape[1] % 2:
            tables = np.pad(tables, ((0, 0), (0, 1), (0, 0)))
        both = (tables[:, ::2, None, :] + tables[:, 1::2, :, None]).reshape(len(queries), -1, 256)
        out = np.zeros((len(queries), len(packed)), np.float32)
        for j in range(packed.shape[1]):
            out += both[:, j][:, packed[:, j]]
        return out

    def centres(self, packed: np.ndarray, d: int) -> np.ndarray:
        """What codes stand for, ``(rows, d)``."""
        codes = np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)[:, : len(self.books)]
        return self.books[np.arange(len(self.books)), codes].reshape(len(packed), -1)[:, :d]

    def rest(self, x: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What codes leave in whole steps, the size of a step, and the lengths of what codes leave and of what both leave."""
        left = x - self.centres(packed, x.shape[1])
        step = np.abs(left).max(1) / STEPS
        whole = np.clip(np.rint(left / np.where(step > 0, step, 1)[:, None]), -STEPS, STEPS).astype("<i2")
        fine = self.centres(packed, x.shape[1]) + whole * step[:, None]
        return whole, step, np.linalg.norm(left, axis=1), np.linalg.norm(x - fine, axis=1)


class Block:
    """Rows of the index, by numpy arrays."""

    def __init__(self, quantiser: Quantiser, x: pd.DataFrame, d: int):
        self.quantiser, self.d = quantiser, d
        self.packed = np.frombuffer(b"".join(x["code"]), np.uint8).reshape(len(x), -1)
        self.coarse, self.error, self.own = (x[c].to_numpy() for c in ("coarse", "error", "own"))
        centres = quantiser.centres(self.packed, d)
        self.square = np.einsum("ij,ij->i", centres, centres)
        self.fine = centres + np.frombuffer(b"".join(x["rest"]), "<i2").reshape(len(x), d) * x["step"].to_numpy()[:, None]
        self.fine_square = np.einsum("ij,ij->i", self.fine, self.fine)

    def candidates(self, units: np.ndarray, own: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and the bounds of their distance, for rows that may be among the ``k`` nearest of a query.

        Rows whose ``own`` is the query's bound nothing; they have no upper bound. Slack stands for rounding: of single
        precision sums in the tables, and of double precision beyond them.
        """
        single, double = 1e-6 * (self.packed.shape[1] + 8), 1e-15 * (self.d + 16)
        approximate = self.quantiser.scores(units, self.packed)
        other = self.own != own[:, None]
        farther = np.where(other, -approximate, np.inf)
        first = np.argpartition(farther, rerank - 1)[:, :rerank] if len(self.own) > rerank else np.broadcast_to(np.arange(len(self.own)), approximate.shape)
        bound = np.full(len(units), np.inf)
        for i, rows in enumerate(first if first.shape[1] >= k else []):
            far = np.sqrt(((self.fine[rows] - units[i]) ** 2).sum(1) + double) + self.error[rows]
            bound[i] = np.partition(np.where(other[i, rows], far, np.inf), k - 1)[k - 1]
        low = np.sqrt(np.maximum(1 + self.square - 2.0 * approximate - single * (1 + self.square), 0)) - self.coarse
        need = np.flatnonzero((low <= bound[:, None]).any(0))
        square = 1 + self.fine_square[need] - 2 * (units @ self.fine[need].T)
        low = np.sqrt(np.maximum(square - double, 0)) - self.error[need]
        high = np.where(other[:, need], np.sqrt(np.maximum(square, 0) + double) + self.error[need], np.inf)
        if len(need) >= k:
            bound = np.minimum(bound, np.partition(high, k - 1)[:, k - 1])
        query, row = np.nonzero(low <= bound[:, None])
        return query, need[row], low[query, row], high[query, row]


def usable(vector: str) -> Column:
    """Not null, not empty, all components finite, and not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _units(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    # scaled first, so that squares of very large or small components stay finite
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return x, scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of pairs of rows in double precision, in one order of operations, so equal vectors score alike."""
    q, x = (v / np.abs(v).max(axis=1, keepdims=True) for v in (q, x))
    return np.einsum("ij,ij->i", x, q) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", q, q)))


def search(
    df: DataFrame,
    queries: DataFrame,
    id_col: str,
    vector: str,
    k: int = 5,
    rerank: int = 128,
    block_rows: int = 65_536,
    block_queries: int = 1024,
    sample_rows: int = 20_000,
) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` nearest rows of each row of ``queries``, another id than its own."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    plain = lambda x: F.col(vector).cast("array<float>" if x.schema[vector].dataType.simpleString() == "array<float>" else "array<double>")
    slim = lambda x: x.where(usable(vector)).select(F.col(id_col).cast(kind).alias("id"), plain(x).alias("v"))
    # written once, so that the number of a row stays what it is
    rows = durable(_distinct(slim(df), k).withColumn("row", F.monotonically_increasing_id()))
    asked = durable(slim(queries.where(F.col(id_col).isNotNull())).withColumns({"d": F.size("v"), "query": F.monotonically_increasing_id()}))
    out = spark.createDataFrame([], f"query_id {kind}, rank int, `{id_col}` {kind}, score double")
    counts = {r["d"]: r["count"] for r in rows.groupBy("d").count().collect()}
    for d, m in sorted((r["d"], r["count"]) for r in asked.groupBy("d").count().collect()):
        if d in counts:
            of = [x.where(F.col("d") == d).drop("d") for x in (rows, asked)]
            # blocks of longer vectors have fewer rows, so that a task holds as much
            row_blocks = -(-counts[d] * max(d, 64) // (64 * block_rows))
            found = _search_length(*of, d, k, rerank, row_blocks, -(-m // block_queries), sample_rows)
            out = out.unionByName(found.withColumnRenamed("id", id_col))
    return out


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """``(v, d, ids, own)``: each vector of ``(id, v)`` once, with every id that a query can find by it and the hash of its only id, or 0.

    A query skips its own id and finds ``k`` rows, so these are the ``k + 1`` least ids, ``k`` times each at most.
    """
    place = F.dense_rank().over(Window.partitionBy("v").orderBy(F.asc_nulls_last("id")))
    nth = F.row_number().over(Window.partitionBy("v", "id").orderBy("id"))
    kept = rows.withColumn("place", place).where(F.col("place") <= k + 1).withColumn("nth", nth).where(F.col("nth") <= k)
    own = F.when(F.max("place") == 1, F.xxhash64(F.min("id"))).otherwise(F.lit(0))
    return kept.groupBy("v").agg(F.collect_list(F.struct("id")).alias("ids"), own.alias("own")).withColumn("d", F.size("v"))


def build_index(rows: DataFrame, sample_rows: int) -> tuple[Quantiser, DataFrame]:
    """A quantiser fitted on at most ``sample_rows`` of ``(row, v, own)`` and the stored index ``(row, own, code, rest, step, coarse, error)`` of all rows."""
    sample = rows.orderBy(F.xxhash64("v"), "row").limit(sample_rows).select("v").toPandas()
    quantiser = Quantiser.fit(_units(sample["v"])[1])
    shared = rows.sparkSession.sparkContext.broadcast(quantiser)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                units = _units(frame["v"])[1]
                packed = shared.value.encode(units)
                whole, step, coarse, error = shared.value.rest(units, packed)
                codes, rests = ([x.tobytes() for x in part] for part in (packed, whole))
                yield pd.DataFrame({"row": frame["row"], "own": frame["own"], "code": codes, "rest": rests, "step": step, "coarse": coarse, "error": error})

    index = durable(rows.select("row", "own", "v").mapInPandas(encode, "row long, own long, code binary, rest binary, step double, coarse double, error double"))
    shared.destroy()
    return quantiser, index


def _search_length(rows: DataFrame, asked: DataFrame, d: int, k: int, rerank: int, row_blocks: int, query_blocks: int, sample_rows: int) -> DataFrame:
    quantiser, index = build_index(rows, sample_rows)
    shared = rows.sparkSession.sparkContext.broadcast(quantiser)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.select(block("row", row_blocks).alias("rb"), every(query_blocks).alias("qb"), *index.columns)
    right = asked.select(every(row_blocks).alias("rb"), block("query", query_blocks).alias("qb"), F.col("query").alias("row"), F.xxhash64("id").alias("own"), "v")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["v"].notna()
        q, x = pdf[asks], pdf[~asks]
        out = [pd.DataFrame({"query": np.zeros(0, np.int64), "row": np.zeros(0, np.int64), "low": np.zeros(0), "high": np.zeros(0)})]
        if len(q) and len(x):
            own, place, held = q["own"].to_numpy(), x["row"].to_numpy(), Block(shared.value, x, d)
            for start in range(0, len(q), 32):
                part = slice(start, start + 32)
                query, row, low, high = held.candidates(_units(q["v"].iloc[part])[1], own[part], k, rerank)
                out.append(pd.DataFrame({"query": q["row"].to_numpy()[part][query], "row": place[row], "low": low, "high": high}))
        return pd.concat(out, ignore_index=True)

    found = left.unionByName(right, allowMissingColumns=True).groupBy("rb", "qb").applyInPandas(scan, "query long, row long, low double, high double")
    # of all blocks' candidates, those that the k-th upper bound leaves
    best = Window.partitionBy("query").orderBy("high").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = found.withColumn("bound", F.nth_value("high", k).over(best)).where(F.col("bound").isNull() | (F.col("low") <= F.col("bound")))
    near = found.select("query", "row").join(rows.select("row", "ids", "v"), "row")
    near = near.join(asked.select("query", F.col("id").alias("query_id"), F.col("v").alias("q")), "query")

    @F.pandas_udf("double")
    def exact(q: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(cosines(*(np.stack(v.to_numpy()).astype(np.float64) for v in (q, x)))) if len(q) else pd.Series(dtype=float)

    scored = near.select("query", "query_id", "ids", exact("q", "v").alias("score")).select("query", "query_id", "score", F.inline("ids"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    others = scored.where(F.col("id").isNull() | (F.col("id") != F.col("query_id")))
    ranked = others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows found for every row whose vec_id is divisible by 50, all rows being candidates."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding")
