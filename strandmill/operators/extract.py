"""Extraction: the cards an extractor reads, the units they travel in, and a rule-based extractor.

The engine does not call a language model. Any table of the same columns can take the place of ``by_rules``, whose
labels are made from a vocabulary file and claim no more than that.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill import config
from strandmill.functions.text import keyed_sha, month_key, phrase_tokens, subject_template, week_key

# The most characters of a card, the shares of its head and tail, and the recipients it names.
MOST, HEAD, TAIL, NAMED = 1600, 0.75, 0.2, 6
EVIDENCE = "array<struct<quote_proposal:string,why:string>>"


def short_address(address: Column, home: str | None = None) -> Column:
    """The part before the @ of addresses in the home domain; others whole; ``(none)`` for nobody."""
    own = address.endswith("@" + home) if home else F.lit(False)
    return F.when(F.coalesce(address, F.lit("")) == "", "(none)").when(own, F.substring_index(address, "@", 1)).otherwise(address)


def cards(messages: DataFrame, home: str | None = None) -> DataFrame:
    """``(msg_uid, card, notes)`` of messages with their triage: the smallest useful view of each that is to be read.

    Long texts lose their middle. Where a message holds a generated table (``table_start``, ``table_rows``, null if
    none), only the prose before it is shown, since no quantity may be taken from such a table.
    """
    rows = messages.where("send_to_model")
    for c, kind in (("table_start", "int"), ("table_rows", "long")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    bare = lambda text: F.regexp_replace(text, r"\A\s+|\s+\z", "")
    novel = bare(F.coalesce("novel_text", F.lit("")))
    head, tail = int(MOST * HEAD), int(MOST * TAIL)
    long_, tabled = F.length(novel) > MOST, F.col("table_start").isNotNull()
    middle = F.concat(F.lit("\n[... "), (F.length(novel) - head - tail).cast("string"), F.lit(" characters left out ...]\n"))
    cut = F.concat(F.substring(novel, F.lit(1), F.lit(head)), middle, F.right(novel, F.lit(tail)))
    prose = F.substring(bare(F.expr("substring(body, 1, table_start)")), F.lit(1), F.lit(MOST))
    shown = F.when(long_ & tabled, prose).when(long_, cut).otherwise(novel)
    notes = F.filter(
        F.array(
            F.when(long_ & tabled, F.concat(F.lit("a generated table of "), F.col("table_rows").cast("string"), F.lit(" rows is left out; take no quantity from it"))),
            F.when(long_ & ~tabled, "the middle of a long message is left out"),
            F.when(F.col("sent_at").isNull(), "no usable date"),
            F.when(F.col("category") == "automated", "the sender looks automated"),
        ),
        lambda n: n.isNotNull(),
    )
    everyone = F.concat("recipients", F.coalesce("cc", F.array().cast("array<string>"))) if "cc" in rows.columns else F.col("recipients")
    rows = rows.withColumns({"_to": everyone, "_notes": notes, "_text": F.when(shown == "", "(empty)").otherwise(shown)})
    more = F.size("_to") - NAMED
    to = F.array_join(F.transform(F.slice("_to", 1, NAMED), lambda a: short_address(a, home)), ", ")
    to = F.when(F.size("_to") == 0, "(none)").when(more > 0, F.concat(to, F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(to)
    parts = [
        F.concat(F.lit("--- MESSAGE "), F.col("msg_uid")),
        F.concat(F.lit("date: "), F.coalesce(F.date_format("sent_at", "yyyy-MM-dd"), F.lit("unknown"))),
        F.concat(F.lit("from: "), short_address(F.col("sender"), home)),
        F.concat(F.lit("to: "), to),
        F.concat(F.lit("folder: "), F.col("folder")),
        F.concat(F.lit("subject: "), F.when(F.coalesce("subject", F.lit("")) == "", "(no subject)").otherwise(F.col("subject"))),
        F.when(F.size("_notes") > 0, F.array_join(F.transform("_notes", lambda n: F.concat(F.lit("note: "), n)), "\n")),
        F.lit("text:"),
        F.col("_text"),
    ]
    return rows.select("msg_uid", F.concat_ws("\n", *parts).alias("card"), F.col("_notes").alias("notes"))


def work(cards_: DataFrame, *versions: str, stage: str = "extract_message") -> DataFrame:
    """``(stage, key, msg_uid, card)``: the key covers the card and whatever else an answer depends on (prompt, model, schema)."""
    key = keyed_sha(F.lit("message"), F.col("card"), *(F.lit(v) for v in versions))
    return cards_.select(F.lit(stage).alias("stage"), key.alias("key"), "msg_uid", "card")


def _found(text: Column, words: list[str]) -> Column:
    return F.regexp_count(text, F.lit(r"(?i)\b(?:" + "|".join(re.escape(w) for w in words) + r")\b"))


def by_rules(messages: DataFrame, vocabulary: dict | None = None) -> DataFrame:
    """Extractions of messages that are to be read, from words alone; every column is a function of subject and novel text."""
    words = vocabulary or config.default("vocabulary")
    text = F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("novel_text", F.lit("")))
    counts = F.array(*[F.struct(_found(text, w).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, w) in enumerate(words["task_classes"].items())])
    best = F.array_max(counts)
    plain = F.regexp_replace(subject_template(F.col("subject")), "<[a-z]+>", " ")
    phrase = F.array_join(F.slice(phrase_tokens(plain), 1, 6), " ")
    bare = lambda line: F.regexp_replace(line, r"\A\s+|\s+\z", "")
    name = F.when(best["n"] > 0, best["name"]).otherwise("other")
    lines = F.filter(F.transform(F.split(F.coalesce("novel_text", F.lit("")), "\n"), bare), lambda x: F.length(x) >= 24)
    quotes = F.transform(F.slice(lines, 1, 2), lambda x: F.struct(F.substring(x, 1, 300).alias("quote_proposal"), F.lit("first lines").alias("why")))
    systems = F.filter(F.array(*[F.when(_found(text, w) > 0, F.lit(s)) for s, w in words["systems"].items()]), lambda s: s.isNotNull())
    rows = messages.where("send_to_model").withColumns({"_class": name, "_phrase": F.when(phrase == "", F.replace(name, F.lit("_"), F.lit(" "))).otherwise(phrase)})
    return rows.select(
        "msg_uid",
        F.lit(True).alias("is_operational"),
        F.col("_class").alias("task_class"),
        F.col("_phrase").alias("process_phrase"),
        F.when(F.col("is_reply"), "responder").otherwise("requester").alias("role"),
        systems.alias("systems"),
        *[(_found(text, w) > 0).alias(s) for s, w in words["signals"].items()],
        quotes.cast(EVIDENCE).alias("evidence"),
        F.lit("medium").alias("confidence"),
    )


def records(extractions: DataFrame, messages: DataFrame, threads: DataFrame, known: DataFrame) -> DataFrame:
    """Operational extractions with what is known of their message: people, thread, months.

    ``threads`` is ``(msg_uid, thread_id)``; a message without one is a thread of its own. ``known`` is ``(address,
    person_id)``; an address without one stands for itself.
    """
    m = messages.select("msg_uid", "sender", "participants", "sent_at", "folder", "novel_hash", "subject_key")
    joined = extractions.where("is_operational").join(m, "msg_uid")
    joined = joined.join(threads.select("msg_uid", "thread_id"), "msg_uid", "left").withColumn("thread_id", F.coalesce("thread_id", "msg_uid"))
    each = joined.select("msg_uid", F.explode("participants").alias("address")).join(known, "address", "left")
    people = each.groupBy("msg_uid").agg(F.array_sort(F.collect_set(F.coalesce("person_id", "address"))).alias("participants"))
    joined = joined.drop("participants").join(people, "msg_uid", "left")
    joined = joined.join(known.withColumnRenamed("address", "sender"), "sender", "left").withColumn("sender", F.coalesce("person_id", "sender")).drop("person_id")
    joined = joined.withColumns({"participants": F.coalesce("participants", F.array().cast("array<string>")), "n_evidence": F.size("evidence")})
    return joined.withColumns({"month": month_key(F.col("sent_at")), "week": week_key(F.col("sent_at"))})


def cluster_prompt(clusters: DataFrame, exemplars: DataFrame, records_: DataFrame) -> DataFrame:
    """``(cluster, prompt)``: a cluster's measures and exemplars as text for whoever is to describe it."""
    shown = exemplars.select("cluster", "msg_uid", "place").join(records_.select("msg_uid", "month", "role", "process_phrase", "evidence"), "msg_uid")
    quotes = F.array_join(F.transform(F.slice("evidence", 1, 2), lambda e: F.concat(F.lit('\n    quote: "'), F.substring(F.translate(e["quote_proposal"], "\n", " "), 1, 240), F.lit('"'))), "")
    line = F.concat(F.lit("  ["), F.col("msg_uid"), F.lit("] "), F.coalesce("month", F.lit("undated")), F.lit(", "), F.col("role"), F.lit(": "), F.col("process_phrase"), quotes)
    lines = shown.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    count = lambda c: F.concat(F.lit(f"  {c}: "), F.col(c).cast("string"))
    measures = F.concat_ws("\n", *[count(c) for c in ("messages", "threads", "senders", "people", "months", "weeks", "folders")])
    joined = clusters.join(lines, "cluster")
    head = F.concat(F.lit("CLUSTER "), F.col("cluster"), F.lit("\nMeasured, not to be contradicted:\n"), measures)
    return joined.select("cluster", F.concat(head, F.lit("\nExemplars:\n"), F.col("lines")).alias("prompt"))
