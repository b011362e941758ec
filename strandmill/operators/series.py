"""Recurring series: one row for each subject template and sender, with its cadence and gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.text import cadence, is_blank, month_key, sha_short, template_words, week_key

MIN_MEMBERS, MIN_INSTANCES, MIN_MONTHS, MIN_WEEKS, MIN_TEMPLATE_WORDS = 3, 8, 3, 3, 2


def gaps(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Add ``gap_days`` to the previous dated row of the same keys; a gap of none is null."""
    before = F.lag(at).over(Window.partitionBy(*keys).orderBy(at))
    seconds = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))
    days = seconds / F.lit(86_400_000_000.0)
    return rows.withColumn("gap_days", F.when(days > 0, days))


def find_series(messages: DataFrame, keys: tuple[str, str] = ("template", "sender"), at: str = "sent_at") -> DataFrame:
    """Series of at least three non-replies.

    ``messages`` has the two keys, ``is_reply`` and a time in message-local terms, null if
    undated; undated messages count in the size only. Replies are counted, not members.
    """
    own = gaps(messages.where(~F.col("is_reply")), list(keys), at)
    series = own.groupBy(*keys).agg(
        F.count("*").alias("instances"),
        F.count_distinct(month_key(F.col(at))).alias("months"),
        F.count_distinct(week_key(F.col(at))).alias("weeks"),
        F.median("gap_days").alias("gap"),
    )
    replies = messages.where("is_reply").groupBy(*keys).agg(F.count("*").alias("replies_excluded"))
    joined = series.where(F.col("instances") >= MIN_MEMBERS).join(replies, list(keys), "left")
    gap = F.round("gap", 2)
    return joined.select(
        *keys,
        sha_short("ser_", F.concat_ws("|", *keys), 10).alias("series_id"),
        "instances",
        "months",
        "weeks",
        gap.alias("median_gap_days"),
        cadence(gap).alias("cadence"),
        F.coalesce("replies_excluded", F.lit(0)).alias("replies_excluded"),
    )


def with_templates(messages: DataFrame, template) -> DataFrame:
    """Messages that have a template of at least two words."""
    named = messages.withColumn("template", template)
    return named.where((F.col("template") != "") & (template_words(F.col("template")) >= MIN_TEMPLATE_WORDS))


def failed_gates(series: DataFrame) -> DataFrame:
    """Add ``failed_gates``, all reasons why a series is not promoted; empty if it is."""
    tests = [("instances", MIN_INSTANCES), ("months", MIN_MONTHS), ("weeks", MIN_WEEKS)]
    reasons = [F.when(F.col(c) < least, F.concat(F.lit(f"{c} "), F.col(c).cast("string"), F.lit(f" < {least}"))) for c, least in tests]
    return series.withColumn("failed_gates", F.filter(F.array(*reasons), lambda r: r.isNotNull()))


def example_subjects(messages: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent subject of each series, ties to the smaller text."""
    counts = messages.where(~F.col("is_reply")).groupBy(*keys, "subject").count()
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), "subject")
    return counts.withColumn("n", F.row_number().over(order)).where("n = 1").select(*keys, F.col("subject").alias("example_subject"))


def recipients_of(messages: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """Recipients of each series by how often they are addressed, at most ``most``."""
    each = messages.where(~F.col("is_reply")).select(*keys, F.explode("recipients").alias("recipient"))
    counts = each.groupBy(*keys, "recipient").count()
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), "recipient")
    top = counts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "recipient"))), lambda x: x["recipient"]).alias("recipients"))


def profiles(messages: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys.., folders, empty_share)`` of each series: where its instances lie and how many of them have no text."""
    own = messages.where(~F.col("is_reply"))
    return own.groupBy(*keys).agg(
        F.array_sort(F.collect_set("folder")).alias("folders"), F.avg(is_blank(F.col("novel_text")).cast("int")).alias("empty_share")
    )


def members(messages: DataFrame, promoted: DataFrame, keys: tuple[str, str] = ("template", "sender")) -> DataFrame:
    """The instances of promoted series, with the series' id as ``finding``; a null sender is a sender of its own."""
    named = promoted.select(F.col("series_id").alias("finding"), *(F.col(k).alias(f"_{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return messages.where(~F.col("is_reply")).join(named, same).drop(*(f"_{k}" for k in keys))
