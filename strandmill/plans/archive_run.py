"""The whole deterministic run over a mail archive, its published form, and the check of that form.

    python -m strandmill.plans.archive_run run ROOT --out FOLDER [--config FILE] [--thresholds FILE]
    python -m strandmill.plans.archive_run verify ROOT --out FOLDER
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill import config
from strandmill.functions.text import subject_template
from strandmill.operators import claims, clusters, dedupe, extract, findings, identity, series, tables, threads, triage, verify
from strandmill.operators.estimate import DERIVATION, Assumptions, subtotals
from strandmill.session import durable
from strandmill.sources import archive, store

KEYS = ("template", "sender")


def sort_messages(spark: SparkSession, root: str, rule: str = "first_blank") -> dict[str, DataFrame]:
    """Files to messages, people, duplicates, threads and triage.

    Parsed messages are written once, since every later step reads some of their columns; the raw text stays in its
    own column, so quotes can be cut from it afterwards.
    """
    messages = durable(archive.parse(archive.raw_files(spark, root), rule))
    addresses = messages.select(F.explode("participants").alias("address"))
    senders = messages.where("sender IS NOT NULL").select(F.col("sender").alias("address"), F.col("sender_display").alias("display"))
    people = durable(identity.people(identity.resolve(addresses, senders), senders))
    known = people.select(F.explode("addresses").alias("address"), "person_id")

    slim = messages.select("msg_uid", "path", "message_id", "content_hash", "sent_at", "sent_at_utc", "subject_key", "novel_text", "body")
    exact = durable(dedupe.exact_duplicates(slim))
    rest = dedupe.survivors(slim, exact).withColumn("text", archive.near_text(slim)).withColumn("sent_at", F.col("sent_at_utc"))
    duplicates = durable(exact.unionByName(dedupe.near_duplicates(rest)))
    kept = dedupe.survivors(messages, duplicates)

    each = kept.select("msg_uid", F.explode_outer("participants").alias("address")).join(known, "address", "left")
    people_of = each.groupBy("msg_uid").agg(F.collect_set(F.coalesce("person_id", "address")).alias("people"))
    timed = kept.select("msg_uid", "path", "subject_key", "is_reply", F.col("sent_at_utc").alias("sent_at"))
    threaded = durable(threads.build_threads(timed.join(people_of, "msg_uid")))
    classified = durable(triage.classify(kept.drop("raw"), ack_only=F.col("is_ack_only"), bulk=F.array_contains("flags", "bulk_x_to")))
    return {"messages": messages, "people": people, "known": known, "duplicates": duplicates, "survivors": kept, "threads": threaded, "triage": classified}


def find(sorted_: dict[str, DataFrame], extractions: DataFrame | None = None, assumed: Assumptions | None = None, thresholds: dict | None = None) -> dict[str, DataFrame]:
    """Series, clusters and the findings they make. ``extractions`` may come from any extractor; rules make them otherwise."""
    messages, known, classified = (sorted_[k] for k in ("messages", "known", "triage"))
    raw = messages.select("path", "source_sha256", "raw")
    extractions = extract.by_rules(classified) if extractions is None else extractions

    # the template takes a chain of patterns, so it is made once
    slim = classified.select("msg_uid", "sender", "subject", "is_reply", "sent_at", "recipients", "participants", "folder", "novel_text")
    by_person = durable(series.with_templates(identity.to_people(slim, "sender", known), subject_template(F.col("subject"))))
    found = durable(series.failed_gates(series.find_series(by_person)))
    promoted = found.where(F.size("failed_gates") == 0)
    profile = series.profiles(by_person, list(KEYS))
    shown = promoted.join(series.example_subjects(by_person, list(KEYS)), list(KEYS)).join(profile, list(KEYS)).join(series.recipients_of(by_person, list(KEYS)), list(KEYS), "left")
    members = series.members(by_person, promoted)
    each = members.select("finding", "msg_uid", F.explode_outer("participants").alias("address")).join(known, "address", "left")
    persons = each.groupBy("finding", "msg_uid").agg(F.array_sort(F.collect_set(F.coalesce("person_id", "address"))).alias("participants"))
    shares = shown.select(F.col("series_id").alias("finding"), "empty_share")
    series_records = findings.series_records(members.drop("participants").join(persons, ["finding", "msg_uid"]).join(shares, "finding"))
    title = F.format_string('"%s", %s', "example_subject", "cadence")
    series_base = shown.select(F.col("series_id").alias("finding"), F.lit("headers").alias("source"), title.alias("title"), F.col("template").alias("label"), F.lit("tight").alias("coherence"), F.lit("email").alias("shape"))

    records = durable(extract.records(extractions, messages, sorted_["threads"], known))
    clustered = durable(records.join(clusters.linkage_clusters(records), "msg_uid"))
    gated = durable(clusters.gate(clusters.metrics(clustered)).join(clusters.cluster_ids(clustered), "cluster"))
    passed = gated.where("passed")
    own = clustered.join(passed.select("cluster", "cluster_id"), "cluster").withColumn("cluster", F.col("cluster_id"))
    own = durable(own.withColumn("finding", F.col("cluster")))
    examples = clusters.exemplars(own)
    named = F.concat_ws(" ", "verb", "keywords")
    cluster_base = clusters.labels(own).select(F.col("cluster").alias("finding"), F.lit("clusters").alias("source"), named.alias("title"), named.alias("label"), F.lit("mixed").alias("coherence"), F.lit("none").alias("shape"))

    subject_cited, short = findings.subject_citations(members.select("finding", "msg_uid", "sent_at"), messages, raw)
    quoted, lost = findings.quote_citations(findings.proposals(own, examples, own), messages, raw)
    cited, missing = durable(subject_cited.unionByName(quoted)), durable(short.unionByName(lost))
    same = series_records.columns
    assembled = durable(findings.assemble(series_base.unionByName(cluster_base), series_records.unionByName(own.select(*same)), cited, missing, assumed))
    limits = artifact_limits(thresholds)
    chosen = claims.select_artifacts(assembled, limits)
    return {"series": found, "promoted_series": shown, "clusters": gated, "records": records, "extractions": extractions, "citations": cited, "uncited": missing, "findings": assembled, "choices": chosen}


def artifact_limits(thresholds: dict | None = None) -> dict:
    """The gate of documents from a thresholds file."""
    a = (thresholds or config.default("thresholds")).get("artifacts", {})
    names = {"citations": "min_verified_citations", "messages": "min_distinct_messages", "instances": "min_instances", "months": "min_months", "dollars": "min_dollars_per_month", "most": "max_artifacts"}
    return {k: a.get(v, claims.ARTIFACT[k]) for k, v in names.items()} | {"exception": a.get("allow_one_judgment_exception", True)}


def run(spark: SparkSession, root: str, rule: str = "first_blank", assumed: Assumptions | None = None, thresholds: dict | None = None) -> dict[str, DataFrame]:
    """All tables of a run by name."""
    done = sort_messages(spark, root, rule)
    done["tables"] = tables.generated_tables(done["survivors"])
    done |= find(done, assumed=assumed, thresholds=thresholds)
    done["manifest"] = archive.manifest(done["messages"])
    return done


#: What is published of a finding, and how it is read back.
_CITATION = "citation_id:string, source_path:string, source_sha256:string, message_id:string, msg_uid:string, quote:string, match_tier:string, raw_start:int, raw_end:int, decoded_start:int, decoded_end:int, line_start:int, line_end:int, repaired:boolean, sender:string, sent_iso:string, subject:string, flags:array<string>"
FINDING = (
    "finding string, source string, title string, label string, task_class string, coherence string, shape string, status string, status_reason string, confidence string, place int,"
    " messages bigint, instances bigint, months bigint, people bigint, senders bigint, dollars decimal(18,2), month_list array<string>, member_uids array<string>,"
    f" derivations array<{DERIVATION}>, citations_list array<struct<{_CITATION}>>, quarantined array<struct<msg_uid:string, source_path:string, reason:string, proposal:string>>"
)


def publish(spark: SparkSession, done: dict[str, DataFrame], out: str, assumed: Assumptions | None = None) -> dict:
    """Write findings, what was left out and why, the method and the report; returns the summary.

    Findings are a few hundred by their gates at most; Spark writes them as JSON lines, and the summary is one small file.
    """
    names = [f.name for f in spark.createDataFrame([], FINDING).schema]
    done["findings"].select(*names).write.mode("overwrite").json(f"{out}/findings")
    done["series"].where(F.size("failed_gates") > 0).write.mode("overwrite").json(f"{out}/residual/series")
    clusters.by_size(done["clusters"].where("NOT passed AND messages >= 3")).write.mode("overwrite").json(f"{out}/residual/clusters")
    done["uncited"].write.mode("overwrite").json(f"{out}/quarantine")
    store.report_lines(done["findings"]).select("line").coalesce(1).write.mode("overwrite").text(f"{out}/report")
    figures = subtotals(findings.band_rows(done["findings"])).collect()
    by = lambda status, column: {r["band"]: r[column] for r in figures if r["status"] == status}
    counted = by("counted", "dollars")
    statuses = {r["finding"]: r["status"] for r in done["findings"].select("finding", "status").collect()}
    statuses_table = done["findings"].select("finding", "status")
    members = done["findings"].select("finding", F.explode("member_uids").alias("msg_uid"))
    operational = done["triage"].where("send_to_model").select("msg_uid")
    read = claims.coverage(operational, done["extractions"], spark.createDataFrame([], "msg_uid string, reason string"))
    covered = read.agg(F.count("*").alias("eligible"), F.count_if("extracted").alias("extracted")).first().asDict()
    tiers = {r["match_tier"]: [r["citations"], r["repaired"]] for r in findings.tier_counts(done["citations"]).collect()}
    assumed = assumed or Assumptions.load()
    summary = {
        "corpus": archive.statistics(done["messages"], done["survivors"], done["triage"]).first().asDict(recursive=True) | done["manifest"].first().asDict(),
        "duplicates": done["duplicates"].count(), "people": done["people"].count(), "threads": done["threads"].select("thread_id").distinct().count(),
        "headline": {"dollars": {b: str(v) for b, v in counted.items()} or {"base": "0.00"}, "hours": by("counted", "hours"), "findings": sum(s == "counted" for s in statuses.values())},
        "not_counted": {s: {b: str(v) for b, v in by(s, "dollars").items()} for s in ("low_confidence", "quarantined")},
        "attribution": claims.attribution(members, statuses_table, operational).first().asDict(), "coverage": covered | {"complete": covered["eligible"] == covered["extracted"]},
        "tiers": tiers, "tables": [r.asDict() for r in done["tables"].collect()],
    }
    store.write_json(spark, f"{out}/summary.json", summary)
    method = {
        "gates": {"series": [series.MIN_INSTANCES, series.MIN_MONTHS, series.MIN_WEEKS], "clusters": [clusters.MIN_CONTENT, clusters.MIN_SENDERS, clusters.MIN_MESSAGES_ALONE, clusters.MIN_MONTHS, clusters.MIN_WEEKS, clusters.MIN_THREADS], "claims": [claims.MIN_CITATIONS, claims.MIN_MESSAGES, claims.MIN_SENDERS, claims.MAX_WEAK_SHARE]},
        "assumptions": {c: {p: {b: str(v) for b, v in bands.items()} for p, bands in parts.items()} for c, parts in assumed.classes.items()} | {"rate": str(assumed.rate)},
    }
    store.write_json(spark, f"{out}/method.json", method)
    return summary


def check(spark: SparkSession, root: str, out: str, rule: str = "first_blank") -> tuple[DataFrame, DataFrame]:
    """Checks of a published folder against the archive, and their roll-up."""
    published = durable(spark.read.schema(FINDING).json(f"{out}/findings"))
    summary = store.read_json(spark, f"{out}/summary.json")
    paths = verify.citations_of(published).select(F.col("source_path").alias("path")).distinct()
    sources = archive.parse(archive.raw_files(spark, root).join(paths, "path", "left_semi"), rule)
    headline = spark.createDataFrame([(summary["headline"]["dollars"].get("base"),)], "dollars string")
    every = verify.citation_checks(published, sources).unionByName(verify.arithmetic_checks(published, headline))
    index = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/documents/index.json")
    if index.getFileSystem(spark._jsc.hadoopConfiguration()).exists(index):
        every = every.unionByName(verify.document_checks(store.read_documents(spark, f"{out}/documents"), published))
    every = durable(every)
    return every, verify.roll_up(every)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Find recurring work in a mail archive, or check what was published.")
    parser.add_argument("action", choices=["run", "verify"])
    parser.add_argument("root")
    parser.add_argument("--out", required=True, help="folder for the published files")
    parser.add_argument("--config", help="assumptions, as TOML, JSON or YAML")
    parser.add_argument("--thresholds", help="when a finding is worth a document")
    parser.add_argument("--rule", default="first_blank", choices=["first_blank", "lf_first"], help="where bodies begin")
    options = parser.parse_args(arguments)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.openCostInBytes", "64k").getOrCreate()
    if options.action == "run":
        assumed = Assumptions.load(options.config)
        done = run(spark, options.root, options.rule, assumed, config.load(options.thresholds) if options.thresholds else None)
        summary = publish(spark, done, options.out, assumed)
        print(summary["headline"])
        return 0
    every, rolled = check(spark, options.root, options.out, options.rule)
    rolled.orderBy("kind").show(truncate=False)
    failed = every.where("problem IS NOT NULL")
    failed.show(25, truncate=False)
    return 0 if failed.isEmpty() else 1


if __name__ == "__main__":
    sys.exit(main())
