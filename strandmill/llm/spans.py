"""Spans of regular expressions in whole texts, as columns, with offsets in code points.

Spark's functions give the matches of a pattern and the pieces between them, but no
offsets. Both come from the same left-to-right search, so the running sum of the lengths of
pieces and matches gives each match its place.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<kind:string,nth:int,start:int,end:int,value:string,base:boolean,score:int>"


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, the group that holds the value, a test of match and value, a cheap pre-test of the text."""

    name: str
    pattern: str
    group: int = 0
    test: Callable[[Column, Column], Column] | None = None
    first: Callable[[Column], Column] | None = None
    base: bool = True
    score: int = 100
    context: str | None = None
    needs: int = 0


def find(df: DataFrame, kinds: list[Kind], text: str, near: int = 40) -> DataFrame:
    """Add ``spans``, an array of ``SPAN`` ordered by start, then kind, for the column ``text``.

    A kind with ``context`` words gains 30 points of score if one of them stands, as a whole word, within ``near`` code
    points before or after the span; a span that scores below ``needs`` is dropped. A word cut by the edge of the
    window counts as it stands there. The text is null-safe: a null text has no spans.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = df.withColumn("_t", body)
    for i, kind in enumerate(kinds):
        likely = kind.first(F.col("_t")) if kind.first else F.lit(True)
        found = found.withColumn(f"_m{i}", F.when(likely, F.regexp_extract_all("_t", F.lit(kind.pattern), F.lit(0))))
        found = found.withColumn(f"_p{i}", F.when(F.size(f"_m{i}") > 0, F.split("_t", kind.pattern, -1)))
    arrays = []
    for i, kind in enumerate(kinds):
        found = found.withColumn(f"_s{i}", _placed(kind, i, F.col(f"_m{i}"), F.col(f"_p{i}"), near))
        arrays.append(F.coalesce(F.col(f"_s{i}"), F.array().cast(f"array<{SPAN}>")))
    every = F.concat(*arrays)
    order = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["nth"].alias("nth"), s.alias("span"))))
    found = found.withColumn("spans", F.transform(order, lambda s: s["span"]))
    return found.drop("_t", *(f"_{x}{i}" for x in "mps" for i in range(len(kinds))))


def _placed(kind: Kind, nth: int, matches: Column, pieces: Column, near: int) -> Column:
    """Matches of one kind with their offsets, those that fail their test dropped.

    The ends of the text before and after are carried along, so windows reach over other matches of the kind.
    """
    count = F.size(matches)
    pairs = F.arrays_zip(matches.alias("match"), F.slice(pieces, 1, count).alias("piece"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["piece"])
        end = start + F.length(pair["match"])
        before = F.right(F.concat(state["seen"], pair["piece"]), F.lit(near)) if kind.context else F.lit("")
        seen = F.right(F.concat(before, pair["match"]), F.lit(near)) if kind.context else F.lit("")
        row = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), pair["match"].alias("match"), before.alias("before"))
        return F.struct(end.cast("int").alias("at"), seen.alias("seen"), F.concat(state["rows"], F.array(row)).alias("rows"))

    def back(state: Column, pair: Column) -> Column:
        after = F.left(F.concat(pair["piece"], state["seen"]), F.lit(near))
        return F.struct(F.left(F.concat(pair["match"], after), F.lit(near)).alias("seen"), F.concat(state["rows"], F.array(after)).alias("rows"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("seen"), F.array().cast("array<struct<start:int,end:int,match:string,before:string>>").alias("rows"))
    rows = F.aggregate(pairs, zero, step, lambda state: state["rows"])
    if kind.context:
        following = F.reverse(F.arrays_zip(matches.alias("match"), F.slice(pieces, 2, count).alias("piece")))
        none = F.struct(F.lit("").alias("seen"), F.array().cast("array<string>").alias("rows"))
        after = F.reverse(F.aggregate(following, none, back, lambda state: state["rows"]))
        rows = F.zip_with(rows, after, lambda row, words: row.withField("after", words))

    def span(row: Column) -> Column:
        value = F.regexp_extract(row["match"], kind.pattern, kind.group) if kind.group else row["match"]
        score = F.lit(kind.score)
        if kind.context:
            word = f"(?:^|[^a-z0-9])(?:{kind.context})(?:[^a-z0-9]|$)"
            score = score + F.when(F.lower(row["before"]).rlike(word) | F.lower(row["after"]).rlike(word), 30).otherwise(0)
        return F.struct(
            F.lit(kind.name).alias("kind"), F.lit(nth).alias("nth"), row["start"].alias("start"), row["end"].alias("end"),
            value.alias("value"), F.lit(kind.base).alias("base"), score.alias("score"),
        )

    spans = F.transform(rows, span)
    if kind.test is not None:
        spans = F.filter(spans, lambda s: kind.test(s["value"], s))
    if kind.needs:
        spans = F.filter(spans, lambda s: s["score"] >= kind.needs)
    return F.when(count > 0, spans)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined, in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def by_kind(spans: Column) -> Column:
    """The same spans ordered by kind as listed, then start."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["nth"].alias("nth"), s["start"].alias("start"), s.alias("span"))))
    return F.transform(order, lambda s: s["span"])


def duck_spans(kinds: list[tuple[str, str, int, str]], columns: str) -> str:
    """DuckDB: CTEs ``f`` with, for each (name, pattern, group, test on v), a list ``s0, s1, ..`` of ``{kind, nth, s, e, v}``.

    They read ``columns`` and the text ``t`` from a CTE ``d``.
    """
    quoted = ["'" + pattern.replace("'", "''") + "'" for _, pattern, _, _ in kinds]
    raw = ", ".join(f"regexp_extract_all(t, {p}) AS m{i}, string_split(regexp_replace(t, {p}, chr(57344), 'g'), chr(57344)) AS q{i}" for i, p in enumerate(quoted))
    lists = []
    for i, (name, _, group, test) in enumerate(kinds):
        value = f"regexp_extract(x.m, {quoted[i]}, {group})" if group else "x.m"
        lists.append(f"""list_filter(list_transform(list_transform(range(1, len(m{i}) + 1), lambda i: {{'m': m{i}[i],
            's': list_sum(list_transform(q{i}[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m{i}[1:i - 1], lambda y: length(y))), 0)}}),
          lambda x: {{'kind': '{name}', 'nth': {i}, 's': x.s::BIGINT, 'e': (x.s + length(x.m))::BIGINT, 'v': {value}}}),
          lambda z: {test.replace("{v}", "z.v")}) AS s{i}""")
    return f"r AS (SELECT *, {raw} FROM d), f AS (SELECT {columns}, {', '.join(lists)} FROM r)"


def duck_joined(lists: list[str], order: str) -> str:
    """DuckDB: ``kind:start:end`` of the spans of several lists, comma-joined; ``order`` is ``start`` or ``kind``."""
    key = "{'a': z.s, 'b': z.nth, 'z': z}" if order == "start" else "{'a': z.nth, 'b': z.s, 'z': z}"
    return (
        f"array_to_string(list_transform(list_sort(list_transform(list_concat({', '.join(lists)}), lambda z: {key})),"
        " lambda y: y.z.kind || ':' || y.z.s || ':' || y.z.e), ',')"
    )
