"""Message archives: loose mail files to a message table with byte offsets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from email.parser import HeaderParser
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.functions.decode import RUNS, decode_body, merged_runs
from strandmill.functions.text import canonical_addresses, content_hash, is_blank, is_reply, message_uid, subject_key, trailer
from strandmill.session import ship

FIRST_YEAR, LAST_YEAR = 1995, 2005
PARSED = (
    "path string, source_sha256 string, size long, raw string, message_id string, subject string, sender_raw string, sender_display string, shown_to string,"
    " to array<string>, cc_raw array<string>, bcc_raw array<string>, sent_at_utc timestamp, sent_at timestamp_ntz, sent_iso string,"
    f" encoding string, content_type string, body_start int, body string, runs {RUNS}"
)


def raw_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``: path from the root's own name on, bytes, size and digest. Text is read as Latin-1, one character a byte."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", root.rstrip("/"))
    above = base.rpartition("/")[0]
    relative = F.regexp_replace(F.col("path"), "^.*?" + re.escape(above) + "/(?=" + re.escape(base.rpartition("/")[2]) + "/)", "")
    return files.select(relative.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("source_sha256"), F.decode("content", "ISO-8859-1").alias("raw"))


def corpus_order(files: DataFrame) -> DataFrame:
    """Add ``place``: folders by name, numbered files by number, then the others by name.

    Files are numbered inside each folder, and a running sum over one row a folder gives where it starts.
    """
    name = F.regexp_extract("path", "([^/]*)$", 1)
    stem = F.regexp_replace(name, r"\.$", "")
    number = F.when(stem.rlike("^[0-9]{1,18}$"), stem.cast("long"))
    foldered = files.withColumn("_folder", F.regexp_replace("path", "/[^/]*$", ""))
    folders = foldered.groupBy("_folder").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_folder").rowsBetween(Window.unboundedPreceding, -1)
    folders = folders.select("_folder", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_folder").orderBy(number.isNull(), number, name)
    placed = foldered.withColumn("_at", F.row_number().over(inside)).join(folders, "_folder")
    return placed.withColumn("place", F.col("_before") + F.col("_at")).drop("_folder", "_before", "_at")


def header_end(raw: str, rule: str = "first_blank") -> int:
    """Start of the body: behind the first blank line of either kind, whichever comes first.

    The rule ``lf_first`` takes the first blank line between plain line feeds wherever one exists. In archives with CRLF
    headers and LF bodies that is a blank line of the body, so its first paragraph is lost; it is here for comparison
    with results that were made that way.
    """
    found = None
    if rule == "lf_first":
        found = re.search(r"\n\n", raw)
    found = found or re.search(r"\r?\n\r?\n", raw)
    return found.end() if found else len(raw)


def sent_time(value: str | None) -> tuple[datetime | None, datetime | None, str | None]:
    """UTC, local time and ISO text of a Date header; a time without zone is UTC, years outside the archive's span are errors."""
    try:
        at = parsedate_to_datetime((value or "").strip())
    except (TypeError, ValueError, IndexError, OverflowError):
        return None, None, None
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    if not FIRST_YEAR <= at.year <= LAST_YEAR:
        return None, None, None
    return at.astimezone(UTC).replace(tzinfo=None), at.replace(tzinfo=None), at.isoformat()


def text_part(raw: str, start: int, headers) -> tuple[int, int, str | None]:
    """Range and encoding of the first text/plain part of a multipart body, else of the whole body."""
    encoding = headers.get("Content-Transfer-Encoding")
    boundary = headers.get_boundary() if headers.get_content_maintype() == "multipart" else None
    if not boundary:
        return start, len(raw), encoding
    mark = "--" + boundary
    at = raw.find(mark, start)
    while at >= 0:
        begin = at + len(mark)
        end = raw.find(mark, begin)
        end = len(raw) if end < 0 else end
        part = raw[begin:end].lstrip("\r\n")
        offset = end - len(part)
        own = HeaderParser().parsestr(part[: header_end(part)])
        if own.get_content_type() == "text/plain" and not raw.startswith("--", begin):
            return offset + header_end(part), end, own.get("Content-Transfer-Encoding")
        at = end if end < len(raw) else -1
    return start, len(raw), encoding


def parse(files: DataFrame, rule: str = "first_blank") -> DataFrame:
    """Parse raw files with the standard mail parser, a batch at a time, then derive the rest with column functions.

    ``recipients`` are those of the To line, ``participants`` the sender and all recipients. A part that the
    author did not write (quoted history behind a trailer) is not ``novel_text``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("out_start", "out_len", "raw_start", "raw_len")
        for frame in frames:
            rows = []
            for f in frame.itertuples():
                start = header_end(f.raw, rule)
                h = HeaderParser().parsestr(f.raw[: header_end(f.raw)])
                begin, end, encoding = text_part(f.raw, start, h)
                body, runs = decode_body(f.raw[begin:end], encoding)
                utc, local, iso = sent_time(h.get("Date"))
                address = lambda n, h=h: [a for _, a in getaddresses([re.sub(r"[\r\n\t]+", " ", v) for v in h.get_all(n, [])])]
                subject = re.sub(r"\r?\n[ \t]+", " ", h.get("Subject") or "").strip()
                rows.append((
                    f.path, f.source_sha256, f.size, f.raw, (h.get("Message-ID") or "").strip() or None, subject, (address("From") or [""])[0],
                    h.get("X-From"), (h.get("X-To") or "").strip() or None, address("To"), address("Cc"), address("Bcc"), utc, local, iso, encoding, h.get_content_type(), begin, body,
                    [dict(zip(names, x, strict=True)) for x in merged_runs(runs)],
                ))
            yield pd.DataFrame(rows, columns=[x.strip().split()[0] for x in PARSED.replace(RUNS, "RUNS").split(",")])

    ship(files.sparkSession)
    parsed = files.select("path", "source_sha256", "size", "raw").mapInPandas(run, PARSED)
    sender = canonical_addresses(F.array("sender_raw"))
    rows = parsed.withColumns(
        {
            "msg_uid": message_uid(F.col("path")),
            "sender": F.when(F.size(sender) > 0, sender[0]),
            "recipients": canonical_addresses(F.col("to")),
            "cc": canonical_addresses(F.col("cc_raw")),
            "others": canonical_addresses(F.concat("to", "cc_raw", "bcc_raw")),
            "subject_key": subject_key(F.col("subject")),
            "is_reply": is_reply(F.col("subject")),
            "folder": F.regexp_replace("path", "/[^/]*$", ""),
            "trailer": trailer(F.col("body")),
        }
    )
    rows = rows.withColumn("novel_text", F.when(F.col("trailer").isNull(), F.col("body")).otherwise(F.substring("body", F.lit(1), F.col("trailer.start"))))
    stamp = F.coalesce(F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm"), F.concat(F.lit("undated:"), F.col("path")))
    nobody = F.size("recipients") == 0
    flags = F.array(
        F.when(F.col("sent_at").isNull(), "no_usable_date"),
        F.when(nobody, "no_to_header"),
        F.when(F.startswith("content_type", F.lit("multipart")), "multipart"),
        F.when(is_blank(F.col("body")), "empty_body"),
        F.when(nobody & F.col("shown_to").isNotNull(), "bulk_x_to"),
        F.when(F.lower(F.trim("encoding")) == "base64", "base64_body"),
    )
    whole = [F.col("subject_key"), F.col("sender"), stamp]
    return rows.withColumns(
        {
            "participants": F.array_distinct(F.concat(F.when(F.col("sender").isNull(), F.array().cast("array<string>")).otherwise(F.array("sender")), "others")),
            "content_hash": content_hash(*whole, F.col("body")),
            "novel_hash": content_hash(*whole, F.col("novel_text")),
            "is_ack_only": F.col("trailer").isNotNull() & is_blank(F.col("novel_text")),
            "flags": F.filter(flags, lambda f: f.isNotNull()),
        }
    ).drop("others", "cc_raw", "bcc_raw", "to")


def near_text(messages: DataFrame) -> Column:
    """What near duplicates are told by: the novel part, or the body where that is blank."""
    return F.when(is_blank(F.col("novel_text")), F.col("body")).otherwise(F.col("novel_text"))


def manifest(files: DataFrame) -> DataFrame:
    """One row with the number of files and a digest over all sorted ``path:sha``, each closed by a NUL.

    Such a digest can only be folded in order, so one task reads the sorted lines; it holds one batch of them at a time.
    """
    lines = files.select(F.concat_ws(":", "path", "source_sha256").alias("line"), F.struct("path", "source_sha256").alias("order"))

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest, count = hashlib.sha256(), 0
        for frame in frames:
            for line in frame["line"]:
                digest.update(line.encode() + b"\x00")
            count += len(frame)
        yield pd.DataFrame({"files": [count], "corpus_sha256": [digest.hexdigest()]})

    ship(files.sparkSession)
    return lines.repartition(1).sortWithinPartitions("order").select("line").mapInPandas(fold, "files long, corpus_sha256 string")


def statistics(messages: DataFrame, survivors: DataFrame, classified: DataFrame) -> DataFrame:
    """One row about the archive: files, mailboxes, folders, dates and how messages were sorted."""
    files = messages.agg(F.count("*").alias("files"), F.array_sort(F.collect_set(F.split_part("path", F.lit("/"), F.lit(2)))).alias("mailboxes"), F.array_sort(F.collect_set("folder")).alias("folders"))
    month = F.date_format("sent_at", "yyyy-MM")
    dates = survivors.agg(
        F.count("*").alias("unique_messages"), F.to_date(F.min("sent_at")).alias("first_day"), F.to_date(F.max("sent_at")).alias("last_day"),
        F.count_distinct(month).alias("months"), F.count_if(F.col("sent_at").isNull()).alias("undated_messages"),
    )
    sorted_ = classified.groupBy("category").agg(F.count("*").alias("n"), F.count_if("send_to_model").alias("sent"))
    kinds = sorted_.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"), F.coalesce(F.sum("sent"), F.lit(0)).alias("messages_to_read"))
    return files.crossJoin(dates).crossJoin(kinds)
