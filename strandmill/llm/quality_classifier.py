"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Texts become sparse hashed features (runs of letters in lower case, of digits and of other characters, and a few
measures of the whole text in bins). One weight vector is shared by all grades, and ordered thresholds
turn its score into ``P(grade >= j)``, which gives the expected grade and tail probabilities for selection.

The model is fitted on the driver over a bounded sample of rated documents: at most
``per_grade`` of each grade, those with the least hashes. Scoring is one pass over all whole texts without a shuffle.

Nulls: a null text is empty and scored like any other; a rating of a null id or grade is
ignored. Repeated rows each get a score. Empty tables give an empty result; without ratings all scores
are null and every document is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.arrays import CHARS, Text, blocks, mix, span_hashes, tidy, utf8, windows
from strandmill.session import table

DIMENSIONS = 1 << 18
_LETTER, _DIGIT, _SPACE, _OTHER = 1, 2, 0, 3
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x80:] = _LETTER


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, feature and value of every non-zero entry, sorted by text, for a block of texts."""
    text = Text(data, off, lower=True)
    n = text.n
    kind = _KIND[text.data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[off] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    solid = kind[starts] != _SPACE if len(starts) else np.zeros(0, bool)
    starts, ends = starts[solid], ends[solid]
    doc = np.searchsorted(off, starts, "right") - 1
    pieces = span_hashes(text.prefix, CHARS, starts, ends)
    # digits count by their length alone
    number = kind[starts] == _DIGIT
    pieces[number] = mix((ends - starts)[number].astype(np.uint64) + np.uint64(977))
    words = text.word_hashes()
    counts = np.maximum(text.counts(), 1)
    first, triples = windows(words, text.doc, 3)
    docs, found = [doc], [pieces]
    own = text.doc[first].astype(np.uint64)
    distinct = np.unique(mix(triples + (own + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    fresh = np.bincount(text.doc[first][distinct], minlength=n) / np.maximum(counts - 2, 1)
    other = np.bincount(doc[kind[starts] == _OTHER], (ends - starts)[kind[starts] == _OTHER], minlength=n) / counts
    upper = (data >= 65) & (data <= 90)
    caps = np.add.reduceat(np.append(upper, False).astype(np.int64), off[:-1]) if n else np.zeros(0)
    caps = np.where(np.diff(off) > 0, caps, 0) / counts
    for i, (measure, step) in enumerate([(fresh, 0.1), (other, 0.25), (caps, 0.5), (np.log2(counts), 1.0), (np.diff(off) / counts, 1.0)]):
        bins = np.minimum(measure / step, 40).astype(np.uint64)
        docs.append(np.arange(n))
        found.append(mix(bins + np.uint64((i + 1) << 32)))
    docs, found = np.concatenate(docs), np.concatenate(found)
    slot = (found >> np.uint64(64 - 18)).astype(np.int64)
    key, many = np.unique(docs * DIMENSIONS + slot, return_counts=True)
    return key // DIMENSIONS, (key % DIMENSIONS).astype(np.int32), np.log1p(many).astype(np.float32)


class OrdinalModel:
    """``P(grade > j) = sigmoid(w x - threshold_j)`` with ascending thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, doc: np.ndarray, slot: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, rounds: int = 200, rate: float = 0.05, decay: float = 1e-3, least_texts: int = 5) -> OrdinalModel:
        """Full-batch Adam on the cumulative-link likelihood; thresholds are a first one plus positive steps."""
        n = len(grade)
        w = np.zeros(DIMENSIONS)
        # features of fewer texts would only be learnt by heart
        common = (np.bincount(slot, minlength=DIMENSIONS) >= least_texts)[slot]
        doc, slot, value = doc[common], slot[common], value[common]
        above = np.array([(grade > j).mean().clip(1e-3, 1 - 1e-3) for j in range(grades - 1)])
        start = -np.log(above / (1 - above))
        steps = np.log(np.maximum(np.diff(start), 1e-2))
        free = np.concatenate([start[:1], steps])
        sizes = [DIMENSIONS, len(free)]
        m, v = [np.zeros(k) for k in sizes], [np.zeros(k) for k in sizes]
        rows = np.arange(n)
        for t in range(1, rounds + 1):
            cut = np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])
            score = np.bincount(doc, w[slot] * value, minlength=n)
            # cumulative probabilities of being above each threshold, with 1 and 0 at the ends
            p = 1 / (1 + np.exp(-np.clip(score[:, None] - cut, -40, 40)))
            p = np.hstack([np.ones((n, 1)), p, np.zeros((n, 1))])
            dp = p * (1 - p)
            likely = np.maximum(p[rows, grade] - p[rows, grade + 1], 1e-9)
            slope = -(dp[rows, grade] - dp[rows, grade + 1]) / likely
            by_cut = np.zeros(grades + 1)
            np.add.at(by_cut, grade, dp[rows, grade] / likely)
            np.add.at(by_cut, grade + 1, -dp[rows, grade + 1] / likely)
            by_cut = by_cut[1:-1] / n
            tail = np.cumsum(by_cut[::-1])[::-1]
            gradients = [np.bincount(slot, slope[doc] * value, minlength=DIMENSIONS) / n + decay * w, np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])]
            for x, g, a, b in zip((w, free), gradients, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                x -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return cls(w, np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))]))

    def tails(self, doc: np.ndarray, slot: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """``P(grade > j)`` for each text and threshold."""
        score = np.bincount(doc, self.weights[slot] * value, minlength=n)
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -40, 40)))


def rated_sample(ratings: DataFrame, id_col: str, per_grade: int) -> DataFrame:
    """At most about ``per_grade`` ratings of each grade, by the hash of the id; of several ratings of one id the least counts."""
    known = ratings.where(F.col(id_col).isNotNull() & F.col("grade").isNotNull()).groupBy(id_col).agg(F.min("grade").alias("grade"))
    counts = {r["grade"]: r["count"] for r in known.groupBy("grade").count().collect()}
    share = F.lit(1.0)
    for grade, count in counts.items():
        share = F.when(F.col("grade") == grade, min(1.0, per_grade / count)).otherwise(share)
    drawn = F.xxhash64(F.col(id_col), F.lit("rating")) / F.lit(2.0**64) + 0.5
    # in the order of their draws, so that a rerun takes the same
    return known.where(drawn < share).orderBy(drawn, id_col).limit(2 * per_grade * max(len(counts), 1))


def fit(df: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text: str = "text", per_grade: int = 4000) -> OrdinalModel | None:
    """Fit on a bounded sample; ``ratings`` has the id and an integer ``grade`` from 0 to ``grades - 1``."""
    sample = rated_sample(ratings, id_col, per_grade)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                doc, slot, value = features(*utf8(part.column(1)))
                off = np.searchsorted(doc, np.arange(part.num_rows + 1))
                lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x)) for x in (slot, value)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), *lists], names=["grade", "slot", "value"])

    # the sample has a bound, so it may be sent to every task; of several texts of one id the least counts
    texts = df.select(id_col, text).join(F.broadcast(sample), id_col).groupBy(id_col).agg(F.min("grade").alias("grade"), F.min(text).alias(text))
    texts = texts.select("grade", text)
    found = texts.mapInArrow(tidy(run), "grade int, slot array<int>, value array<float>").toArrow()
    if not found.num_rows:
        return None
    # sums of floats depend on the order of rows
    found = found.combine_chunks()
    order = sorted(range(found.num_rows), key=lambda i: (found.column("grade")[i].as_py(), found.column("slot")[i].as_py(), found.column("value")[i].as_py()))
    found = found.take(pa.array(order, pa.int64())).combine_chunks()
    slot, value = (found.column(c).chunk(0) for c in ("slot", "value"))
    doc = np.repeat(np.arange(found.num_rows), np.diff(slot.offsets.to_numpy()))
    return OrdinalModel.fit(doc, slot.flatten().to_numpy(), value.flatten().to_numpy(), found.column("grade").to_numpy(), grades)


def score(df: DataFrame, model: OrdinalModel | None, grades: int, id_col: str = "doc_id", text: str = "text", least: float = 0.65) -> DataFrame:
    """``id, expected_grade, p_ge_1, .., kept`` of every row; kept if the top grade is at least as likely as ``least``."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [f"p_ge_{j}" for j in range(1, grades)]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                n = part.num_rows
                if shared.value is None:
                    blank = pa.nulls(n, pa.float64())
                    columns = [blank, *([blank] * len(names)), pa.array(np.ones(n, bool))]
                else:
                    tails = np.round(shared.value.tails(*features(*utf8(part.column(1))), n), 6)
                    columns = [pa.array(np.round(tails.sum(1), 6)), *(pa.array(x) for x in tails.T), pa.array(tails[:, -1] >= least)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[id_col, "expected_grade", *names, "kept"])

    schema = f"`{id_col}` {kind}, expected_grade double, {', '.join(f'{x} double' for x in names)}, kept boolean"
    return df.select(id_col, text).mapInArrow(tidy(run), schema)


def grades_of(labels: DataFrame) -> DataFrame:
    """Grade 0 for toxic documents, 1 for others of low quality, 2 for the rest."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.cast("int").alias("grade"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and verdict of every document, by a model fitted on the rated ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, grades_of(table(spark, sf_dir, "labels")), 3)
    return score(docs, model, 3)
