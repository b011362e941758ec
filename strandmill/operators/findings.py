"""Findings: promoted series and clusters with citations cut from the source bytes, gates, estimates and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.text import line_bounds, month_key, sha_short
from strandmill.operators import claims, estimate, evidence
from strandmill.session import durable

#: Fields of a citation, in the order they are published.
CITATION = [
    "citation_id", "source_path", "source_sha256", "message_id", "msg_uid", "quote", "match_tier", "raw_start", "raw_end", "decoded_start", "decoded_end",
    "line_start", "line_end", "repaired", "sender", "sent_iso", "subject", "flags",
]


def subject_line(raw: Column) -> Column:
    """``struct<start, end>`` of the first line of at least 24 characters that begins with ``Subject:``; null without one."""
    bare = lambda line: F.regexp_replace(line, r"\s+\z", "")
    lines = F.filter(F.split(raw, "\n"), lambda x: x.startswith("Subject:") & (F.length(bare(x)) >= evidence.MIN_QUOTE))
    line = bare(F.get(lines, F.lit(0)))
    at = F.call_function("locate", line, raw) - 1
    return F.when(line.isNotNull(), F.struct(at.cast("int").alias("start"), (at + F.length(line)).cast("int").alias("end")))


def spread_members(members: DataFrame, by: str = "finding", most: int = claims.MAX_CITATIONS) -> DataFrame:
    """Every k-th member in order of time, k = max(1, members // most), with its ``priority``; undated ones last.

    A few more than ``most`` can remain, so that one that can't be cited has a stand-in.
    """
    own = Window.partitionBy(by)
    order = own.orderBy(F.col("sent_at").isNull(), "sent_at", "msg_uid")
    placed = members.withColumn("_n", F.row_number().over(order) - 1).withColumn("_k", F.greatest(F.floor(F.count("*").over(own) / most), F.lit(1)))
    return placed.where(F.col("_n") % F.col("_k") == 0).withColumn("priority", (F.col("_n") / F.col("_k")).cast("long")).drop("_n", "_k")


def _cited(rows: DataFrame) -> DataFrame:
    """Citation rows from ``finding, priority, anchor``, message columns and ``raw``; the quote is always cut from the source."""
    a = F.col("anchor")
    rows = rows.withColumn("quote", F.expr("substring(raw, anchor.raw_start + 1, anchor.raw_end - anchor.raw_start)"))
    rows = rows.where(F.length(F.regexp_replace("quote", r"\A\s+|\s+\z", "")) >= evidence.MIN_QUOTE)
    lines = line_bounds(F.col("raw"), a["raw_start"], a["raw_end"])
    cid = sha_short("cit_", F.concat_ws("|", "path", a["raw_start"].cast("string"), a["raw_end"].cast("string")), 12)
    flags = F.array(
        F.when(a["tier"] != "raw_exact", F.concat(F.lit("tier_"), a["tier"])),
        F.when(~a["tier"].isin(*claims.STRONG_TIERS), "weak_tier"),
        F.when(a["repaired"], "repaired_to_source_text"),
    )
    made = {
        "citation_id": cid, "source_path": F.col("path"), "match_tier": a["tier"], "raw_start": a["raw_start"], "raw_end": a["raw_end"], "decoded_start": a["decoded_start"],
        "decoded_end": a["decoded_end"], "line_start": lines["line_start"], "line_end": lines["line_end"], "repaired": a["repaired"], "flags": F.array_sort(F.filter(flags, lambda f: f.isNotNull())),
    }
    return rows.withColumns(made).select("finding", "priority", *CITATION)


def _first(citations: DataFrame, most: int = claims.MAX_CITATIONS) -> DataFrame:
    """Of each finding the first distinct citations in order of priority."""
    once = citations.withColumn("_n", F.row_number().over(Window.partitionBy("finding", "citation_id").orderBy("priority", "msg_uid"))).where("_n = 1")
    order = Window.partitionBy("finding").orderBy("priority", "citation_id")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("_n")


def subject_citations(members: DataFrame, messages: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations of subject lines spread over each finding's members, and the members that could not be cited.

    ``members`` is ``(finding, msg_uid, sent_at)``. Only the sources of sampled members are joined in.
    """
    m = messages.select("msg_uid", "path", "message_id", "sender", "sent_iso", "subject")
    rows = spread_members(members).select("finding", "msg_uid", "priority").join(m, "msg_uid").join(raw.select("path", "source_sha256", "raw"), "path")
    rows = rows.withColumn("at", subject_line(F.col("raw")))
    none = F.lit(0)
    anchor = F.struct(
        F.col("at.start").alias("raw_start"), F.col("at.end").alias("raw_end"), none.alias("decoded_start"), none.alias("decoded_end"),
        F.lit("raw_exact").alias("tier"), F.lit(False).alias("repaired"),
    )
    short = rows.where("at IS NULL").select("finding", "msg_uid", F.col("path").alias("source_path"), F.lit("subject line too short").alias("reason"), F.substring("subject", 1, 160).alias("proposal"))
    return _first(_cited(rows.where("at IS NOT NULL").withColumn("anchor", anchor))), short


def quote_citations(proposals: DataFrame, messages: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations from proposed quotes ``(finding, msg_uid, priority, quote)``, and the proposals that no source holds.

    A proposal is a search key only: what is published is cut from the source.
    """
    m = messages.select("msg_uid", "path", "message_id", "sender", "sent_iso", "subject", "body", "runs", "body_start")
    rows = proposals.where(F.trim(F.coalesce("quote", F.lit(""))) != "").join(m, "msg_uid").join(raw.select("path", "source_sha256", "raw"), "path")
    rows = rows.withColumn("anchor", evidence.anchored(F.col("quote"), F.col("raw"), F.col("body"), F.col("runs"), F.col("body_start")))
    lost = rows.where("anchor.error IS NOT NULL").select("finding", "msg_uid", F.col("path").alias("source_path"), F.col("anchor.error").alias("reason"), F.substring("quote", 1, 160).alias("proposal"))
    return _first(_cited(rows.where("anchor.error IS NULL").drop("quote"))), lost


def proposals(members: DataFrame, exemplars: DataFrame, records: DataFrame) -> DataFrame:
    """Proposed quotes of clusters, exemplars first, then the other members by id."""
    chosen = exemplars.select(F.col("cluster").alias("finding"), "msg_uid", F.col("place").cast("long").alias("first"))
    rows = members.select("finding", "msg_uid").join(chosen, ["finding", "msg_uid"], "left").join(records.select("msg_uid", "evidence"), "msg_uid")
    each = rows.select("finding", "msg_uid", "first", F.posexplode("evidence").alias("nth", "e")).select("finding", "msg_uid", "first", "nth", F.col("e.quote_proposal").alias("quote"))
    order = Window.partitionBy("finding").orderBy(F.asc_nulls_last("first"), "msg_uid", "nth")
    return each.withColumn("priority", F.row_number().over(order).cast("long")).select("finding", "msg_uid", "priority", "quote")


def series_records(series_members: DataFrame) -> DataFrame:
    """Record-shaped members of series: each instance is a task of its own and shows no signals but empty bodies."""
    no = F.lit(False)
    return series_members.select(
        "finding", "msg_uid", "sender", "participants", "sent_at", "folder", F.col("msg_uid").alias("thread_id"), F.lit("recurring_report").alias("task_class"),
        no.alias("rework_signal"), no.alias("waiting_signal"), (F.col("empty_share") > 0.5).alias("manual_transfer_signal"), no.alias("deadline_signal"),
    )


def assemble(base: DataFrame, records: DataFrame, citations: DataFrame, lost: DataFrame, assumed: estimate.Assumptions | None = None) -> DataFrame:
    """One row a finding: measures, derivations by band, citations, status with its reason, confidence and place.

    ``base`` is ``(finding, source, title, label, coherence, shape)``; ``records`` are the members, which carry the
    task class. Findings without enough evidence are kept as quarantined and stay out of totals.
    """
    # written, so that the derivations are made once however many columns read them
    measured = durable(estimate.with_derivations(estimate.measure(records, "finding"), assumed))
    counts = claims.citation_counts(citations)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*CITATION).alias("c")))), lambda x: x["c"])
    cited = citations.groupBy("finding").agg(listed.alias("citations_list"))
    missing = lost.groupBy("finding").agg(F.array_sort(F.collect_list(F.struct("msg_uid", "source_path", "reason", "proposal"))).alias("quarantined"))
    who = records.select("finding", F.explode("participants").alias("p")).groupBy("finding").agg(F.count_distinct("p").alias("people"))
    when = records.groupBy("finding").agg(F.array_sort(F.collect_set(month_key(F.col("sent_at")))).alias("month_list"), F.array_sort(F.collect_set("msg_uid")).alias("member_uids"))
    rows = base.join(measured, "finding")
    for side in (counts, cited, missing, who, when):
        rows = rows.join(side, "finding", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("citations", "cited_messages", "cited_senders", "strong", "people")})
    status = claims.status(F.col("coherence"), F.col("messages"))
    reason = claims.status_reason(F.col("coherence"), F.col("messages"))
    sure = claims.confidence(F.col("coherence"), F.col("senders"), F.size("month_list"))
    rows = rows.withColumns({"status": status, "status_reason": reason, "confidence": sure})
    dollars = F.element_at(F.filter("derivations", lambda d: d["band"] == "base"), 1)["result"]["dollars_per_month"]
    return claims.ranked(durable(rows.withColumn("dollars", dollars)))


def band_rows(findings: DataFrame) -> DataFrame:
    """``(finding, status, band, hours, dollars)``, one row a finding and band; hours are the automatable ones."""
    each = findings.select("finding", "status", F.explode("derivations").alias("d"))
    return each.select("finding", "status", "d.band", F.col("d.result.automatable_hours_per_month").alias("hours"), F.col("d.result.dollars_per_month").alias("dollars"))


def tier_counts(citations: DataFrame) -> DataFrame:
    """``(match_tier, citations, repaired)``."""
    return citations.groupBy("match_tier").agg(F.count("*").alias("citations"), F.count_if("repaired").alias("repaired"))


def document_prompt(findings: DataFrame) -> DataFrame:
    """``(finding, prompt)``: a finding's measures and citations as text for whoever is to draft its document."""
    cited = F.transform(
        "citations_list",
        lambda c: F.concat(F.lit("  ["), c["citation_id"], F.lit('] "'), F.trim(F.translate(c["quote"], "\r\n", " ")), F.lit('"\n      '), c["source_path"], F.lit(", "), F.coalesce(c["sent_iso"], F.lit("undated")), F.lit(", "), F.coalesce(c["sender"], F.lit("unknown"))),
    )
    prompt = F.concat_ws(
        "\n",
        F.format_string("FINDING %s: %s", "finding", "title"),
        F.format_string("kind of work: %s; document: %s", "task_class", "shape"),
        F.format_string("measured: %d messages in %d instances, %d senders, %d people, months %s", "messages", "instances", "senders", "people", F.array_join("month_list", ", ")),
        F.lit("citations, the only ones that may be used:"),
        F.array_join(cited, "\n"),
        F.lit("Close every sentence about today's practice with a citation id in brackets; proposals stand under '## Recommended change' and carry none."),
    )
    return findings.select("finding", prompt.alias("prompt"))
