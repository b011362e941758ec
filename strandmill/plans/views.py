"""Message-shaped views over the star-schema tables, in Spark and in SQL.

The engine's operators work on messages. These views give the test tables that shape;
every made-up value is a pure function of a key, so SQL can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.session import table

SUBJECTS = [
    "Nomination for meter 1234 on 4/12/01",
    "Credit Report--4/3/01",
    "Lunch on Friday",
    "Out of office: back Monday 10:30 am",
    "Invoice settlement for March",
    "Weekly bulletin",
    "Capacity Report for Week of 01/21-01/25",
    "volumes.xls",
    "Imbalance allocation, pipeline volume and tariff lunch",
    "Status",
    "",
]
BODIES = [
    "please confirm the volume and the meter allocation",
    "see attached",
    "",
    "click here to unsubscribe from this list",
    "the deal entry is off by 3 hours and $ 45, invoice to follow",
    "can you reply to all of us about the plan for next week because the schedule has changed again and we need to know who will take part in it",
    "flow date moved, capacity and storage estimate attached",
]
PLACES = ["north", "south", "harbor", "valley", "ridge"]
TAILS = ["for the morning desk", "with the field office", "as agreed on the phone", "see the notes", "no change since then", "by the end of today"]
PHRASES = [
    "confirm meter volume allocation",
    "confirm meter volume estimate",
    "send weekly capacity report",
    "send capacity report",
    "reconcile invoice settlement variance",
    "update deal ticket entry",
    "review the invoice settlement",
]
OBJECTS = ["", "for the plant", "with counterparty", "across the pool", "before noon cutoff", "in the ledger", "per station"]
CLASSES = ["gas_nomination", "recurring_report", "invoice_settlement", "other"]
SYSTEMS = ["sitara", "unify", "excel", "email"]


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message an order: uid, path, sender, participants, subject, reply flag, body, time, folder."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    key = F.col("o_orderkey")
    reply = key % 5 == 0
    base = _pick(SUBJECTS, key + F.floor(key / 16))
    number = F.when(key % 3 == 0, F.concat((key % 100).cast("string"), F.lit(" "))).otherwise("")
    named = F.when(base == "", "").otherwise(F.concat(_pick(PLACES, F.floor(key / 176)), F.lit(" "), number, base))
    subject = F.concat(F.when(reply, "RE: ").otherwise(""), named)
    body = _pick(BODIES, key + F.floor(key / 8))
    told = F.concat(body, F.lit(" "), _pick(TAILS, F.floor(key / 56)), F.lit(" ref "), (key % 700).cast("string"))
    # blank texts are empty or line ends, and some texts are long
    novel = F.when(body == "", F.when(key % 2 == 0, "").otherwise("\n \n")).when(key % 401 == 0, F.repeat(told, F.lit(40))).otherwise(told)
    sender = F.when(key % 40 == 7, "no-reply@example.org").otherwise(F.concat(F.lit("clerk"), (F.col("o_custkey") % 25).cast("string"), F.lit("@example.org")))
    to = F.concat(F.lit("desk"), (key % 7).cast("string"), F.lit("@example.org"))
    sent = F.when(key % 97 != 0, F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (key % 3600).cast("decimal(18,6)")))
    return o.select(
        key.alias("key"),
        F.concat(F.lit("box/"), F.col("o_orderstatus"), F.lit("/"), key.cast("string"), F.lit(".")).alias("path"),
        F.concat(F.lit("m_"), F.substring(F.sha2(F.concat(F.lit("box/"), F.col("o_orderstatus"), F.lit("/"), key.cast("string"), F.lit(".")), 256), 1, 12)).alias("msg_uid"),
        sender.alias("sender"),
        F.array(sender, to).alias("participants"),
        subject.alias("subject"),
        reply.alias("is_reply"),
        novel.alias("novel_text"),
        sent.alias("sent_at"),
        F.col("o_orderstatus").alias("folder"),
        F.when(key % 11 == 0, F.concat(F.lit("mid"), F.floor(key / 44).cast("string"))).alias("message_id"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction-shaped rows over the same orders."""
    m = messages(spark, sf_dir)
    key = F.col("key")
    return m.select(
        "key", "msg_uid", "sender", "participants", "folder", "sent_at", "subject",
        _pick(CLASSES, key).alias("task_class"),
        F.trim(F.concat(_pick(PHRASES, key + F.floor(key / 32)), F.lit(" "), _pick(OBJECTS, F.floor(key / 224)))).alias("process_phrase"),
        (key % 3 == 0).alias("rework_signal"),
        (key % 7 < 2).alias("waiting_signal"),
        (key % 2 == 0).alias("manual_transfer_signal"),
        (key % 10 == 1).alias("deadline_signal"),
        _pick(["clerk", "analyst", "manager"], key).alias("role"),
        F.array(_pick(SYSTEMS, key), _pick(SYSTEMS, key + 1)).alias("systems"),
        F.concat(F.lit("t"), F.floor(key / 6).cast("string")).alias("thread_id"),
        F.sha2(F.concat_ws("|", "subject", "novel_text"), 256).alias("novel_hash"),
        (key % 4).cast("int").alias("n_evidence"),
    )


def with_sources(messages_: DataFrame) -> DataFrame:
    """The same messages with a raw source each: a subject line, a blank line, the text."""
    raw = F.concat(F.lit("Subject: "), F.col("subject"), F.lit("\n\n"), F.col("novel_text"))
    return messages_.withColumns({"raw": raw, "source_sha256": F.sha2(raw, 256), "sent_iso": F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss")})


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_pick(values: list[str], n: str) -> str:
    return f"({_sql_list(values)})[(({n}) % {len(values)}) + 1]"


_BASE, _BODY = _sql_pick(SUBJECTS, "o_orderkey + o_orderkey // 16"), _sql_pick(BODIES, "o_orderkey + o_orderkey // 8")
_TOLD = f"{_BODY} || ' ' || {_sql_pick(TAILS, 'o_orderkey // 56')} || ' ref ' || (o_orderkey % 700)"
_SUBJECT = f"CASE WHEN {_BASE} = '' THEN '' ELSE {_sql_pick(PLACES, 'o_orderkey // 176')} || ' ' || CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 100) || ' ' ELSE '' END || {_BASE} END"
_NOVEL = f"CASE WHEN {_BODY} = '' THEN CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE chr(10) || ' ' || chr(10) END WHEN o_orderkey % 401 = 0 THEN repeat({_TOLD}, 40) ELSE {_TOLD} END"

MESSAGES_SQL = f"""
messages AS (
  SELECT o_orderkey AS key, 'box/' || o_orderstatus || '/' || o_orderkey || '.' AS path,
         'm_' || substr(sha256('box/' || o_orderstatus || '/' || o_orderkey || '.'), 1, 12) AS msg_uid,
         CASE WHEN o_orderkey % 40 = 7 THEN 'no-reply@example.org' ELSE 'clerk' || (o_custkey % 25) || '@example.org' END AS sender,
         'desk' || (o_orderkey % 7) || '@example.org' AS desk,
         CASE WHEN o_orderkey % 5 = 0 THEN 'RE: ' ELSE '' END || {_SUBJECT} AS subject,
         o_orderkey % 5 = 0 AS is_reply, {_NOVEL} AS novel_text,
         CASE WHEN o_orderkey % 97 <> 0 THEN o_orderdate + to_seconds(o_orderkey % 3600) END AS sent_at,
         o_orderstatus AS folder, CASE WHEN o_orderkey % 11 = 0 THEN 'mid' || (o_orderkey // 44) END AS message_id
  FROM orders)"""

RECORDS_SQL = f"""{MESSAGES_SQL},
records AS (
  SELECT key, msg_uid, sender, [sender, desk] AS participants, folder, sent_at, subject,
         {_sql_pick(CLASSES, "key")} AS task_class, trim({_sql_pick(PHRASES, "key + key // 32")} || ' ' || {_sql_pick(OBJECTS, "key // 224")}) AS process_phrase,
         key % 3 = 0 AS rework_signal, key % 7 < 2 AS waiting_signal, key % 2 = 0 AS manual_transfer_signal,
         key % 10 = 1 AS deadline_signal, {_sql_pick(["clerk", "analyst", "manager"], "key")} AS role,
         [{_sql_pick(SYSTEMS, "key")}, {_sql_pick(SYSTEMS, "key + 1")}] AS systems, 't' || (key // 6) AS thread_id,
         sha256(subject || '|' || novel_text) AS novel_hash, (key % 4)::INT AS n_evidence
  FROM messages)"""
