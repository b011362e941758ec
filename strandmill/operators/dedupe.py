"""Exact and near duplicates of messages."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.text import fold
from strandmill.session import durable

# Fixed values of the near-duplicate tier.
SHINGLE, PERMUTATIONS, MASK = 5, 128, (1 << 61) - 1
MULTIPLIER, MULTIPLIER_STEP = 0x9E3779B97F4A7C15, 0x100000001B3
ADDEND, ADDEND_STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MIN_WORDS, MAX_BLOCK, SAME_MOMENT_SECONDS, NEAR = 25, 400, 120, 0.90


def _rank_columns() -> list[Column]:
    return [F.col("sent_at").isNull(), F.col("sent_at"), F.length("path"), F.col("path")]


def exact_tier(messages: DataFrame, key: str, reason: str) -> DataFrame:
    """``(msg_uid, canonical_uid, reason)`` of the copies under one key; a null key groups nothing.

    The first of each key is a partial aggregate and is joined back, so a key that very many messages share is no one task's.
    """
    keyed = messages.where(F.col(key).isNotNull()).select("msg_uid", key, F.struct(*(c.alias(f"o{i}") for i, c in enumerate(_rank_columns())), F.col("msg_uid").alias("uid")).alias("rank"))
    first = keyed.groupBy(key).agg(F.min("rank")["uid"].alias("canonical_uid"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(first, key).where("msg_uid <> canonical_uid").select("msg_uid", "canonical_uid", F.lit(reason).alias("reason"))


def exact_duplicates(messages: DataFrame) -> DataFrame:
    """Copies by message id, then by content among the rest.

    Keys and ranks are written once, without the texts that they may have been made of.
    """
    slim = durable(messages.select("msg_uid", "message_id", "content_hash", "sent_at", "path"))
    by_id = exact_tier(slim, "message_id", "same message id")
    rest = slim.join(by_id.select("msg_uid"), "msg_uid", "left_anti")
    return by_id.unionByName(exact_tier(rest, "content_hash", "same content"))


def survivors(messages: DataFrame, duplicates: DataFrame) -> DataFrame:
    return messages.join(duplicates.select("msg_uid"), "msg_uid", "left_anti")


def groups(duplicates: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """One row a canonical message and reason, its copies by id; with ``(msg_uid, place)`` in the order of the archive."""
    listed = F.array_sort(F.collect_list("msg_uid"))
    found = duplicates.groupBy("canonical_uid", "reason").agg(listed.alias("duplicate_uids"))
    if placed is None:
        return found
    return found.join(placed.select(F.col("msg_uid").alias("canonical_uid"), "place"), "canonical_uid", "left").orderBy("place", "reason")


def words_of(text: Column) -> Column:
    return F.split(fold(F.lower(F.coalesce(text, F.lit("")))), " ")


def shingle_set(words: Column, width: int = SHINGLE) -> Column:
    """Distinct hashes of word shingles; a shorter text is one shingle, an empty one has none.

    ``words`` must be a column of its own, not an expression: it is read once for each shingle.
    """
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))
    none = F.array().cast("array<bigint>")
    return F.when(F.array_join(words, "") == "", none).when(F.size(words) < width, F.array(F.xxhash64(words))).otherwise(F.array_distinct(windows))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def blocks(messages: DataFrame, block: str = "subject_key", most: int = MAX_BLOCK) -> DataFrame:
    """``(block, messages, left_out)`` of each block of two or more: which ones the tier leaves alone for their size."""
    sizes = messages.where(F.col(block) != "").groupBy(block).agg(F.count("*").alias("messages")).where("messages >= 2")
    return sizes.withColumn("left_out", F.col("messages") > most)


def near_candidates(messages: DataFrame, block: str = "subject_key", text: str = "text", most: int = MAX_BLOCK) -> DataFrame:
    """Pairs of one block, sent within two minutes or both undated; ``n`` is the rank in the block.

    Blocks hold 2 to ``most`` messages (larger ones are left alone, as the tier is defined; ``blocks`` lists them, and their texts go
    no further than the count) and only texts of at least 25 words. The time condition is part of the join key in
    windows of its own length, so a block is not paired with itself as a whole.
    """
    fit = blocks(messages, block, most).where("NOT left_out").select(F.col(block).alias("_block"))
    sized = messages.join(fit, F.col(block) == F.col("_block")).select("msg_uid", block, "sent_at", "path", F.array_join(words_of(F.col(text)), " ").alias("folded"))
    rank = F.row_number().over(Window.partitionBy(block).orderBy(*_rank_columns()))
    seconds = F.unix_seconds(F.col("sent_at").cast("timestamp"))
    # texts wait here; only those of messages that meet another are cut into shingles
    long_ = durable(sized).where(F.size(F.split("folded", " ")) >= MIN_WORDS)
    ranked = long_.select("msg_uid", block, rank.alias("n"), seconds.alias("s"))
    slot = F.coalesce(F.floor(F.col("s") / SAME_MOMENT_SECONDS), F.lit(-1))
    left = ranked.withColumn("slot", F.explode(F.when(F.col("s").isNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(F.array(slot - 1, slot, slot + 1))))
    right = ranked.select(*(F.col(c).alias(f"{c}_b") for c in ranked.columns)).withColumn("slot", F.coalesce(F.floor(F.col("s_b") / SAME_MOMENT_SECONDS), F.lit(-1)))
    met = left.join(right, (F.col(block) == F.col(f"{block}_b")) & (left["slot"] == right["slot"]) & (F.col("n") < F.col("n_b")))
    same = F.col("s").isNull() & F.col("s_b").isNull() | (F.abs(F.col("s") - F.col("s_b")) <= SAME_MOMENT_SECONDS)
    pairs = durable(met.where(same).select(F.col(block), F.col("msg_uid").alias("a"), F.col("msg_uid_b").alias("b"), "n", "n_b"))
    needed = pairs.select(F.col("a").alias("msg_uid")).union(pairs.select("b")).distinct()
    words = long_.select("msg_uid", F.split("folded", " ").alias("words")).join(needed, "msg_uid", "left_semi")
    sets = durable(words.select("msg_uid", shingle_set(F.col("words")).alias("set")))
    a, b = (sets.select(F.col("msg_uid").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select(block, "a", "b", "n", "n_b", jaccard(F.col("set_a"), F.col("set_b")).alias("jaccard"))


def claim(pairs: DataFrame, block: str = "subject_key") -> DataFrame:
    """Greedy claims in rank order: a message claimed by an earlier one claims nothing. Blocks are bounded."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        owner: dict[str, str] = {}
        for row in pdf.sort_values(["n", "n_b"]).itertuples():
            if row.a not in owner and row.b not in owner:
                owner[row.b] = row.a
        return pd.DataFrame({"msg_uid": list(owner), "canonical_uid": list(owner.values())})

    return pairs.groupBy(block).applyInPandas(run, "msg_uid string, canonical_uid string")


def near_duplicates(messages: DataFrame, block: str = "subject_key", text: str = "text", near: float = NEAR, most: int = MAX_BLOCK) -> DataFrame:
    found = claim(near_candidates(messages, block, text, most).where(F.col("jaccard") >= near), block)
    return found.withColumn("reason", F.lit(f"near copy, similarity {near} or more"))


def minhash_signature(texts: pd.Series) -> pd.Series:
    """Signatures of 128 minima of ``(a x + b) & mask`` over 64-bit shingle hashes; unsigned products wrap, which the mask allows."""
    k = np.arange(PERMUTATIONS, dtype=object)
    low = (1 << 64) - 1
    a = np.array([(MULTIPLIER + i * MULTIPLIER_STEP) & low for i in k], np.uint64)[:, None]
    b = np.array([(ADDEND + i * ADDEND_STEP) & low for i in k], np.uint64)[:, None]

    def one(text: str | None) -> np.ndarray:
        folded = " ".join((text or "").lower().split())
        words = folded.split()
        grams = {" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)} if len(words) >= SHINGLE else {folded} - {""}
        if not grams:
            return np.zeros(PERMUTATIONS, np.int64)
        x = np.array([int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") for g in grams], np.uint64)
        least = np.full(PERMUTATIONS, MASK, np.uint64)
        # a part at a time, so that a long text needs no wide table
        for start in range(0, len(x), 4096):
            least = np.minimum(least, ((a * x[start : start + 4096] + b) & np.uint64(MASK)).min(axis=1))
        return least.astype(np.int64)

    return pd.Series([one(t) for t in texts])


def with_minhash(messages: DataFrame, text: str = "text") -> DataFrame:
    return messages.withColumn("signature", F.pandas_udf(minhash_signature, "array<long>")(F.col(text)))


def signature_similarity(a: Column, b: Column) -> Column:
    """Share of positions at which two signatures agree."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)
