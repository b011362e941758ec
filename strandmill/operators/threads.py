"""Task instances: replies join the latest opened thread of their subject that is recent enough and shares a person."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.session import ship

MAX_GAP_SECONDS = 10 * 86_400


def chain(rows: list[tuple], most_gap: float = MAX_GAP_SECONDS) -> list[int]:
    """Thread number of each of one subject's dated messages ``(seconds, is_reply, people)``, given in order of time.

    A bare subject opens a thread. A reply joins the most recently opened thread whose last
    message is at most ``most_gap`` back and which shares a person; else it opens one.
    """
    last: list[float] = []
    known: list[set] = []
    live: list[int] = []
    out = []
    for at, reply, people in rows:
        people = set(people)
        live = [i for i in live if at - last[i] <= most_gap]
        home = None
        if reply:
            home = next((i for i in reversed(live) if known[i] & people), None)
        if home is None:
            home = len(last)
            last.append(at)
            known.append(set())
            live.append(home)
        last[home] = at
        known[home] |= people
        out.append(home)
    return out


def thread_id(key: str, uids: list[str]) -> str:
    return "t_" + hashlib.sha256((key + "|" + "|".join(sorted(uids))).encode()).hexdigest()[:12]


def build_threads(messages: DataFrame, key: str = "subject_key") -> DataFrame:
    """``(msg_uid, thread_id, subject)`` for ``(msg_uid, path, key, sent_at, is_reply, people)``.

    Messages without a subject or a date stand alone and skip the grouped step, so an empty
    subject never gathers in one group. A subject's timeline is cut at gaps that no reply can
    bridge, and each part is dealt to a task; a task works through its parts one after another, with one
    part in memory. The rule is sequential, so a part without such a gap is not split further.
    """
    columns = ["msg_uid", "path", F.coalesce(key, F.lit("")).alias("subject"), F.unix_micros(F.col("sent_at").cast("timestamp")).alias("micros"), "is_reply", "people"]
    rows = messages.select(*columns)
    alone = (F.col("subject") == "") | F.col("micros").isNull()
    single = F.concat(F.lit("t_"), F.substring(F.sha2(F.concat_ws("|", "subject", "msg_uid"), 256), 1, 12))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come sorted, so groups follow each other; only the last one of a batch may go on in the next
        held: list[tuple] = []

        def closed(rows_: list[tuple]) -> list[tuple]:
            home = chain([(micros / 1e6, reply, people) for _, _, micros, reply, people in rows_])
            uids: dict[int, list[str]] = {}
            for number, row in zip(home, rows_, strict=True):
                uids.setdefault(number, []).append(row[0])
            ids = {number: thread_id(rows_[0][1][0], own_) for number, own_ in uids.items()}
            return [(row[0], ids[number], row[1][0]) for number, row in zip(home, rows_, strict=True)]

        for frame in frames:
            out: list[tuple] = []
            for uid, subject, part, micros, reply, people in zip(*(frame[c] for c in ("msg_uid", "subject", "part", "micros", "is_reply", "people")), strict=True):
                if held and held[0][1] != (subject, part):
                    out += closed(held)
                    held = []
                held.append((uid, (subject, part), micros, reply, people))
            yield pd.DataFrame(out, columns=["msg_uid", "thread_id", "subject"])
        if held:
            yield pd.DataFrame(closed(held), columns=["msg_uid", "thread_id", "subject"])

    ship(messages.sparkSession)
    # gaps show between the first and last times of days, of which a subject has few however many messages it has
    dated = rows.where(~alone).withColumn("day", F.floor(F.col("micros") / 86_400_000_000))
    days = dated.groupBy("subject", "day").agg(F.min("micros").alias("first"), F.max("micros").alias("last"))
    own = Window.partitionBy("subject").orderBy("day")
    # a second more than the gap, since the rule compares seconds as floats
    far = F.coalesce(F.col("first") - F.lag("last").over(own) > (MAX_GAP_SECONDS + 1) * 1_000_000, F.lit(False))
    days = days.withColumn("far", far.cast("int")).withColumn("part", F.sum("far").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    parts = dated.join(days.select("subject", "day", "part"), ["subject", "day"])
    dealt = parts.repartition("subject", "part").sortWithinPartitions("subject", "part", "micros", "path")
    chained = dealt.select("msg_uid", "subject", "part", "micros", "is_reply", "people").mapInPandas(run, "msg_uid string, thread_id string, subject string")
    return rows.where(alone).select("msg_uid", single.alias("thread_id"), "subject").unionByName(chained)


def thread_table(members: DataFrame, messages: DataFrame) -> DataFrame:
    """One row a thread: its subject, size and people."""
    joined = members.join(messages.select("msg_uid", "people"), "msg_uid")
    people = joined.select("thread_id", F.explode_outer("people").alias("person")).groupBy("thread_id").agg(F.array_sort(F.collect_set("person")).alias("people"))
    sizes = members.groupBy("thread_id", "subject").agg(F.count("*").alias("size"))
    return sizes.join(people, "thread_id", "left")


def stream_threads(messages: DataFrame, key: str = "subject_key") -> DataFrame:
    """The same rule over a stream: open threads of each subject are the state (an extra of this engine).

    Messages of one micro-batch are taken in order of time; threads idle for longer than the
    gap leave the state. Emits ``(subject, msg_uid, thread)`` with a running thread number.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(subject: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, numbers, last, people = state.get if state.exists else (0, [], [], [])
        numbers, last, people = list(numbers), list(last), [set(p.split("\x1f")) for p in people]
        rows = pd.concat(list(frames)).sort_values(["micros", "msg_uid"])
        out = []
        for row in rows.itertuples():
            own = set(row.people)
            fits = [i for i in range(len(last)) if row.is_reply and row.micros - last[i] <= MAX_GAP_SECONDS * 1e6 and people[i] & own]
            if fits:
                i = fits[-1]
            else:
                i = len(last)
                numbers.append(opened)
                last.append(0)
                people.append(set())
                opened += 1
            last[i] = row.micros
            people[i] |= own
            out.append((subject[0], row.msg_uid, numbers[i]))
        newest = max(last, default=0)
        live = [i for i in range(len(last)) if newest - last[i] <= MAX_GAP_SECONDS * 1e6]
        state.update((opened, [numbers[i] for i in live], [last[i] for i in live], ["\x1f".join(sorted(people[i])) for i in live]))
        yield pd.DataFrame(out, columns=["subject", "msg_uid", "thread"])

    rows = messages.select(F.col(key).alias("subject"), "msg_uid", F.unix_micros(F.col("sent_at").cast("timestamp")).alias("micros"), "is_reply", "people")
    return rows.groupBy("subject").applyInPandasWithState(
        run,
        "subject string, msg_uid string, thread long",
        "opened long, numbers array<long>, last array<long>, people array<string>",
        "append",
        GroupStateTimeout.NoTimeout,
    )
