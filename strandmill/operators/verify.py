"""Checks of published results against the sources and against themselves.

Every family of checks gives rows ``(kind, key, problem)``, one a check; ``problem`` is null where it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators import claims, estimate, evidence


def mismatches(published: DataFrame, recomputed: DataFrame, key: str, value: str, within: float = 0.0) -> DataFrame:
    """Keys whose published value differs from the recomputed one, or that one side lacks."""
    left = published.select(key, F.col(value).alias("published"))
    right = recomputed.select(key, F.col(value).alias("recomputed"))
    both = left.join(right, key, "full_outer")
    same = F.abs(F.col("published") - F.col("recomputed")) <= within
    return both.where(~F.coalesce(same, F.lit(False)))


def checks(published: DataFrame, recomputed: DataFrame, key: str, value: str, within: float = 0.0) -> DataFrame:
    """``(problem, rows)``: how many keys agree, differ, or stand on one side alone."""
    left = published.select(key, F.col(value).alias("published"), F.lit(True).alias("_l"))
    right = recomputed.select(key, F.col(value).alias("recomputed"), F.lit(True).alias("_r"))
    both = left.join(right, key, "full_outer")
    problem = (
        F.when(F.col("_r").isNull(), "not recomputed")
        .when(F.col("_l").isNull(), "not published")
        .when(F.abs(F.col("published") - F.col("recomputed")) > within, "differs")
        .otherwise("agrees")
    )
    return both.groupBy(problem.alias("problem")).agg(F.count("*").alias("rows"))


def disjoint(shipped: DataFrame, quarantined: DataFrame, key: str) -> DataFrame:
    """Keys that are both shipped and quarantined; none is right."""
    return shipped.select(key).intersect(quarantined.select(key))


def bands_in_order(estimates: DataFrame, key: str) -> DataFrame:
    """Findings whose low, base and high dollars are not in order."""
    wide = estimates.groupBy(key).pivot("band", ["low", "base", "high"]).agg(F.first("dollars"))
    return wide.where(~((F.col("low") <= F.col("base")) & (F.col("base") <= F.col("high"))))


def citations_of(findings: DataFrame) -> DataFrame:
    """One row a published citation, with its finding."""
    return findings.select("finding", F.explode("citations_list").alias("c")).select("finding", "c.*")


def citation_checks(findings: DataFrame, sources: DataFrame, quarantined: DataFrame | None = None) -> DataFrame:
    """Whether each citation still stands in its source, at its tier, on its lines, and is not quarantined too.

    ``sources`` has ``path, raw, body, runs, body_start`` and the digest of the file as it is now. Only cited sources
    are joined, by path.
    """
    cited = citations_of(findings)
    now = sources.select(F.col("path").alias("source_path"), F.col("source_sha256").alias("_sha"), "raw", "body", "runs", "body_start")
    rows = evidence.reverified(cited.join(now, "source_path", "left"))
    window = F.array_join(F.slice(F.split("raw", "\n"), F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n")
    # the blanks of SQL's expressions, which a vertical tab is none of
    on_lines = F.contains(window, F.col("quote")) | F.contains(window, F.regexp_replace("quote", r"\A[ \t\n\f\r]+|[ \t\n\f\r]+\z", ""))
    if quarantined is not None:
        marked = quarantined.select("citation_id").distinct().withColumn("_both", F.lit(True))
        rows = rows.join(marked, "citation_id", "left")
    else:
        rows = rows.withColumn("_both", F.lit(None).cast("boolean"))
    problem = (
        F.when(F.col("_sha").isNull(), "source missing")
        .when(F.col("_sha") != F.col("source_sha256"), "source changed")
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(~F.coalesce(on_lines, F.lit(False)), "lines do not hold the quote")
        .when(F.col("_both"), "shipped and quarantined")
    )
    return rows.select(F.lit("citation").alias("kind"), F.concat_ws("/", "finding", "citation_id").alias("key"), problem.alias("problem"))


def arithmetic_checks(findings: DataFrame, headline: DataFrame) -> DataFrame:
    """Whether figures follow from their derivations, bands are in order, and the counted ones add up to the headline.

    ``headline`` is one row with the published ``dollars`` of the base band.
    """
    each = findings.select("finding", "status", "dollars", "derivations", F.explode_outer("derivations").alias("d"))
    again = each.withColumn("again", estimate.recomputed(F.col("d")))
    stated = F.col("d.result.dollars_per_month")
    sums = F.when(F.col("d").isNull(), "no derivation").when(F.col("again").isNull(), "derivation can't be used").when(F.col("again") != stated, "recomputed figure differs")
    steps = again.select(F.lit("recompute").alias("kind"), F.concat_ws("/", "finding", "d.band").alias("key"), sums.alias("problem"))
    of = lambda band: F.get(F.filter("derivations", lambda d: d["band"] == band), F.lit(0))["result"]["dollars_per_month"]
    result = F.when(F.col("dollars").isNull() | (of("base") != F.col("dollars")), "derivation states another figure")
    bands = F.when(~((of("low") <= of("base")) & (of("base") <= of("high"))), "bands out of order")
    own = findings.select(F.lit("result").alias("kind"), F.col("finding").alias("key"), result.alias("problem"))
    order = findings.select(F.lit("bands").alias("kind"), F.col("finding").alias("key"), bands.alias("problem"))
    whole = findings.where("status = 'counted'").agg(F.coalesce(F.sum("dollars"), F.lit(0)).cast("decimal(28,2)").alias("parts"))
    total = whole.crossJoin(headline.select(F.col("dollars").cast("decimal(28,2)").alias("published")))  # one row each
    agrees = F.when(F.col("published").isNull(), "no headline").when(F.col("published") != F.col("parts"), "headline is not the sum of its parts")
    return steps.unionByName(own).unionByName(order).unionByName(total.select(F.lit("headline").alias("kind"), F.lit("base").alias("key"), agrees.alias("problem")))


def document_checks(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """Whether every citation marker of each document ``(name, finding, body)`` is a citation of its finding."""
    allowed = findings.select("finding", F.transform("citations_list", lambda c: c["citation_id"]).alias("allowed"))
    rows = documents.join(allowed, "finding", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))
    unknown = F.array_sort(F.array_except(F.regexp_extract_all("body", F.lit(r"\[(cit_[0-9a-f]{12})\]"), F.lit(1)), F.col("allowed")))
    problem = F.when(F.col("body").isNull(), "document missing").when(F.size(unknown) > 0, F.concat(F.lit("unknown markers "), F.array_join(unknown, ", ")))
    return rows.select(F.lit("document").alias("kind"), F.col("name").alias("key"), problem.alias("problem"))


def completeness(findings: DataFrame, coverage: DataFrame, documents: DataFrame) -> DataFrame:
    """Warnings ``(kind, detail)``: messages that were never read, and no document although findings are counted."""
    gaps = coverage.agg(F.count("*").alias("eligible"), F.count_if("extracted").alias("read")).where("read < eligible")
    gaps = gaps.select(F.lit("incomplete coverage").alias("kind"), F.format_string("%d of %d messages were read", "read", "eligible").alias("detail"))
    counted, written = (x.agg(F.count("*").alias(c)) for x, c in ((findings.where("status = 'counted'"), "counted"), (documents, "documents")))
    bare = counted.crossJoin(written).where("counted > 0 AND documents = 0")  # one row each
    return gaps.unionByName(bare.select(F.lit("no documents").alias("kind"), F.format_string("%d findings are counted", "counted").alias("detail")))


def weak_share(findings: DataFrame) -> DataFrame:
    """One row: citations, those of weak tiers, and whether they are too many."""
    rows = citations_of(findings).agg(F.count("*").alias("citations"), F.count_if(~F.col("match_tier").isin(*claims.STRONG_TIERS)).alias("weak"))
    return rows.withColumn("too_many", F.col("weak") > claims.MAX_WEAK_SHARE * F.col("citations"))


def roll_up(*families: DataFrame) -> DataFrame:
    """``(kind, checks, failures)`` over families of checks."""
    every = families[0]
    for other in families[1:]:
        every = every.unionByName(other)
    return every.groupBy("kind").agg(F.count("*").alias("checks"), F.count("problem").alias("failures"))
