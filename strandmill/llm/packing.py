"""Best-fit packing by hierarchical residual merging.

Each partition tokenizes its documents, cuts those longer than a sequence, and packs the
pieces best-fit in decreasing order. Bins that are nearly full are final; underfull bins go up
a tree: an eighth as many partitions repack them as items, again best-fit, until one partition
is left or merging no longer pays. The number of items a partition may get is a parameter, so
no task grows with the input. Each round is written to the shared folder, so a lost executor
repeats one round at most, and a partition's items are sorted before packing, so a
repeated task gives the same bins.

Nulls: a null text is empty and still takes one closing id. Repeated rows are packed one by
one. An empty table gives an empty result. Very long texts are cut into pieces of a full
sequence; only the first piece may be shorter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.arrays import blocks, tidy, utf8
from strandmill.llm.tokens import encoder
from strandmill.session import durable, table

#: A bin with at most this share of its length free is final.
NEARLY_FULL = 1 / 256
PIECE = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the fill of each bin.

    Open bins are kept in a stack for each free length; a bit mask of the free lengths in use
    finds the tightest one, so an item costs the same however many bins are open.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    mask = 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fit = mask >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            stack = stacks[free]
            b = stack.pop()
            if not stack:
                mask ^= 1 << free
        else:
            b, free = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if left := free - size:
            stacks[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def _pieces(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, number and start of each piece; all pieces but a first, shorter one are full."""
    count = np.maximum(-(-sizes // capacity), 1)
    doc = np.repeat(np.arange(len(sizes)), count)
    piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    head = sizes - (count - 1) * capacity
    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
    return doc, piece, start


def _number(level: int, partition: int, bins: np.ndarray) -> np.ndarray:
    return (level << 56) + (partition << 28) + bins


def _repack(rows: pd.DataFrame, capacity: int, level: int) -> pd.DataFrame:
    """Pack the bins of ``rows`` as items; every row of a bin is among ``rows``."""
    rows = rows.sort_values(["sequence_id", "offset"], kind="stable").reset_index(drop=True)
    item, first = np.unique(rows["sequence_id"].to_numpy(), return_index=True)
    which = np.searchsorted(item, rows["sequence_id"].to_numpy())
    bins, base, fills = best_fit(rows["fill"].to_numpy()[first], capacity)
    rows["offset"] = rows["offset"] + base[which]
    rows["sequence_id"] = _number(level, TaskContext.get().partitionId(), bins[which])
    rows["fill"] = fills[bins[which]]
    return rows


def pack(
    df: DataFrame,
    definition: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    capacity: int = 2048,
    close: int = 0,
    fan_in: int = 8,
    most_items: int = 100_000,
) -> DataFrame:
    """Tokenize and pack every row; one row per piece with the columns ``keep`` and those of ``PIECE``.

    ``definition`` is the JSON of a ``tokenizers`` tokenizer; ``close`` ends each document.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(definition)
    columns = [(c, df.schema[c].dataType.simpleString()) for c in keep]
    schema = ", ".join(f"`{c}` {kind}" for c, kind in columns) + ", " + PIECE

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        kept, doc_of, parts = [], [], []
        done = 0
        for batch in batches:
            for part in blocks(batch, text):
                ids, off = encode(*utf8(part.column(part.schema.get_field_index(text))))
                closed = np.insert(ids, off[1:], close).astype("<u4")
                off = off + np.arange(len(off))
                doc, piece, start = _pieces(np.diff(off), capacity)
                begin = off[doc] + start
                end = np.append(begin[1:], len(closed))
                raw = closed.tobytes()
                crc = np.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(begin.tolist(), end.tolist(), strict=True)], np.int64)
                parts.append((piece, start, end - begin, crc))
                kept.append(part.select(list(keep)))
                doc_of.append(doc + done)
                done += part.num_rows
        if not done:
            return
        piece, start, length, crc = (np.concatenate(x) for x in zip(*parts, strict=True))
        bins, offset, fills = best_fit(length, capacity)
        number = _number(0, TaskContext.get().partitionId(), bins)
        held = pa.Table.from_batches(kept).take(pa.array(np.concatenate(doc_of)))
        arrays = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, number, offset, fills[bins]))]
        names = [x.split()[0] for x in PIECE.split(", ")]
        yield from pa.table([*held.columns, *arrays], names=[*keep, *names]).to_batches(100_000)

    def next_round(level: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = list(frames)
            if found and sum(map(len, found)):
                yield _repack(pd.concat(found, ignore_index=True), capacity, level)

        return run

    packed = durable(df.select(*keep, text).mapInArrow(tidy(first_round), schema))
    final = F.col("fill") >= capacity - int(capacity * NEARLY_FULL)
    finished = [packed.where(final)]
    open_, parts = packed.where(~final), packed.rdd.getNumPartitions() * fan_in
    before = None
    for level in range(1, 100):
        items, rows = open_.agg(F.count(F.when(F.col("offset") == 0, 1)), F.count("*")).first()
        if items <= 1 or (parts == 1 and before is not None):
            break
        # merging has stopped to pay: as many partitions as before and hardly fewer bins
        parts_now = max(1, parts // fan_in, -(-rows // most_items))
        if before is not None and parts_now >= parts and items > 0.99 * before:
            break
        parts, before = parts_now, items
        dealt = open_.repartition(parts, F.xxhash64("sequence_id", F.lit(level)))
        packed = durable(dealt.mapInPandas(next_round(level), open_.schema))
        finished.append(packed.where(final))
        open_ = packed.where(~final)
    finished.append(open_)
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out


def op10_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """The pieces of all documents, packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer)


def pack_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The pieces of ``docs`` (``doc_id``, ``text``) with their sequences; ``tokenizer`` is the path of a definition, by default a public one."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    packed = pack(docs.select("doc_id", "text"), Path(tokenizer).read_text(encoding="utf-8"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
