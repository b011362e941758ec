"""Claims: gates over citations, confidence, ranking, artifact selection and spread samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the claim and artifact gates.
STRONG_TIERS = ["raw_exact", "decoded_exact", "rewrapped"]
MIN_CITATIONS, MIN_MESSAGES, MIN_SENDERS, ENOUGH_MESSAGES, MAX_WEAK_SHARE, MAX_CITATIONS = 3, 2, 2, 15, 0.40, 8
STATUS_ORDER = ["counted", "low_confidence", "quarantined"]
ARTIFACT = {"citations": 5, "messages": 4, "instances": 6, "months": 3, "dollars": 55.0, "most": 6}


def citation_counts(citations: DataFrame, by: str = "finding") -> DataFrame:
    return citations.groupBy(by).agg(
        F.count("*").alias("citations"),
        F.count_distinct("msg_uid").alias("cited_messages"),
        F.count_distinct("sender").alias("cited_senders"),
        F.count_if(F.col("match_tier").isin(*STRONG_TIERS)).alias("strong"),
    )


def status(coherence: Column, messages: Column) -> Column:
    """Counted, low confidence or quarantined; reads the columns of ``citation_counts``."""
    weak = F.col("citations") - F.col("strong")
    return (
        F.when(F.col("citations") < MIN_CITATIONS, "quarantined")
        .when(F.col("cited_messages") < MIN_MESSAGES, "quarantined")
        .when((F.col("cited_senders") < MIN_SENDERS) & (messages < ENOUGH_MESSAGES), "quarantined")
        .when(weak / F.col("citations") > MAX_WEAK_SHARE, "low_confidence")
        .when(F.col("strong") == 0, "low_confidence")
        .when(coherence == "incoherent", "low_confidence")
        .otherwise("counted")
    )


def status_reason(coherence: Column, messages: Column) -> Column:
    """Why a claim is not counted, empty if it is; the tests are those of ``status`` in the same order."""
    weak = F.col("citations") - F.col("strong")
    text = lambda c: c.cast("string")
    return (
        F.when(F.col("citations") < MIN_CITATIONS, F.concat(F.lit("citations "), text(F.col("citations")), F.lit(f" < {MIN_CITATIONS}")))
        .when(F.col("cited_messages") < MIN_MESSAGES, F.concat(F.lit("cited messages "), text(F.col("cited_messages")), F.lit(f" < {MIN_MESSAGES}")))
        .when((F.col("cited_senders") < MIN_SENDERS) & (messages < ENOUGH_MESSAGES), F.concat(F.lit("cited senders "), text(F.col("cited_senders")), F.lit(f" < {MIN_SENDERS}")))
        .when(weak / F.col("citations") > MAX_WEAK_SHARE, F.concat(text(weak), F.lit(" weak of "), text(F.col("citations"))))
        .when(F.col("strong") == 0, F.lit("no strong citation"))
        .when(coherence == "incoherent", F.lit("incoherent"))
        .otherwise("")
    )


def confidence(coherence: Column, senders: Column, months: Column) -> Column:
    high = (coherence == "tight") & (F.col("strong") >= 3) & (senders >= 2) & (months >= 4)
    return F.when(high, "high").when((coherence == "incoherent") | (F.col("strong") == 0), "low").otherwise("medium")


def top_citations(citations: DataFrame, by: str = "finding", most: int = MAX_CITATIONS) -> DataFrame:
    """The first distinct citations of each finding in order of ``priority``."""
    first = citations.groupBy(by, "citation_id").agg(F.min("priority").alias("priority"))
    order = Window.partitionBy(by).orderBy("priority", "citation_id")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def status_rank(status: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), status), F.lit(99))


def ranked(findings: DataFrame) -> DataFrame:
    """Rank by status, dollars and id.

    Places inside a status and dollar band of powers of two are numbered apart; a running sum over one row a band, of which
    there are a few hundred at most, tells where each begins. So no task holds all findings.
    """
    dollars = F.col("dollars").cast("double")
    band = F.when(F.isnan(dollars), F.lit(2**63 - 1)).when(dollars > 0, F.floor(F.log2(dollars))).otherwise(-2000)  # NaN sorts above all
    lots = findings.withColumns({"_rank": status_rank(F.col("status")), "_band": band})
    counts = lots.groupBy("_rank", "_band").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_rank", F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_rank", "_band", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_rank", "_band").orderBy(F.desc("dollars"), "finding")
    placed = lots.withColumn("_at", F.row_number().over(inside)).join(starts, ["_rank", "_band"])
    return placed.withColumn("place", (F.col("_before") + F.col("_at")).cast("int")).drop("_rank", "_band", "_before", "_at")


def artifact_reasons(least: dict = ARTIFACT) -> Column:
    """Why a finding gets no document; dollars are judged apart."""
    short = [("citations", "citations"), ("cited_messages", "messages"), ("instances", "instances"), ("months", "months")]
    tests = [
        F.when(F.col("status") != "counted", F.col("status")),
        F.when(F.col("confidence") == "low", F.lit("low confidence")),
        F.when(F.coalesce("shape", F.lit("")).isin("", "none"), F.lit("no shape of document")),
        *[F.when(F.col(c) < least[k], F.concat(F.lit(f"{k} "), F.col(c).cast("string"), F.lit(f" < {least[k]}"))) for c, k in short],
    ]
    return F.filter(F.array(*tests), lambda r: r.isNotNull())


def select_artifacts(findings: DataFrame, least: dict = ARTIFACT) -> DataFrame:
    """Add ``reasons`` and ``choice``: selected, capped, near_miss (the best of those short of money alone), short or rejected.

    The few that are chosen are found by ordered limits, which hold no more than these in a task.
    """
    rows = findings.withColumn("reasons", artifact_reasons(least))
    fit = (F.size("reasons") == 0) & (F.col("dollars") >= least["dollars"])
    near = (F.size("reasons") == 0) & (F.col("dollars") < least["dollars"])
    rows = rows.withColumn("pool", F.when(fit, "fit").when(near, "near").otherwise("rejected"))
    fitting, nearly = rows.where("pool = 'fit'"), rows.where("pool = 'near'")
    best = fitting.orderBy(F.desc("dollars"), "finding").limit(least["most"]).select("finding", F.lit("selected").alias("_pick"))
    miss = nearly.orderBy(F.desc("citations"), F.desc("dollars"), "finding").limit(int(least.get("exception", True))).select("finding", F.lit("near_miss").alias("_pick"))
    other = F.when(F.col("pool") == "fit", "capped").when(F.col("pool") == "near", "short").otherwise("rejected")
    return rows.join(best.unionByName(miss), "finding", "left").withColumn("choice", F.coalesce("_pick", other)).drop("pool", "_pick")


def spread_sample(rows: DataFrame, by: str, order: list, most: int = 8) -> DataFrame:
    """Every k-th row of each group in order, k = max(1, rows // most), at most ``most`` rows."""
    own = Window.partitionBy(by)
    placed = rows.withColumn("_n", F.row_number().over(own.orderBy(*order)) - 1).withColumn("_k", F.greatest(F.floor(F.count("*").over(own) / most), F.lit(1)))
    return placed.where((F.col("_n") % F.col("_k") == 0) & (F.col("_n") / F.col("_k") < most)).withColumn("place", (F.col("_n") / F.col("_k") + 1).cast("int")).drop("_n", "_k")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by the hash of a key and a seed; the sample is the feature, and reruns agree."""
    return rows.orderBy(F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))), 256), key).limit(n)


def coverage(eligible: DataFrame, extracted: DataFrame, reasons: DataFrame) -> DataFrame:
    """Eligible messages with ``extracted`` and, for those without, why."""
    done = extracted.select("msg_uid").distinct().withColumn("extracted", F.lit(True))
    joined = eligible.select("msg_uid").join(done, "msg_uid", "left").join(reasons.select("msg_uid", "reason"), "msg_uid", "left")
    gap = ~F.coalesce("extracted", F.lit(False))
    return joined.select("msg_uid", F.coalesce("extracted", F.lit(False)).alias("extracted"), F.when(gap, F.coalesce("reason", F.lit("stage_deadline"))).alias("reason"))


def attribution(members: DataFrame, statuses: DataFrame, operational: DataFrame) -> DataFrame:
    """Distinct members of counted findings that are operational, and their share of all operational messages."""
    counted = members.join(statuses.where("status = 'counted'").select("finding"), "finding", "left_semi")
    own = counted.select("msg_uid").distinct().withColumn("hit", F.lit(1))
    joined = operational.select("msg_uid").join(own, "msg_uid", "left")
    sums = joined.agg(F.count("hit").alias("attributed"), F.count("*").alias("operational"))
    return sums.withColumn("share", F.round(F.when(F.col("operational") > 0, F.col("attributed") / F.col("operational")).otherwise(0.0), 4))
