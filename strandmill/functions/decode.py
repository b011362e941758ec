"""Transfer decoding that keeps, for every decoded character, its place in the raw text.

A map is a list of runs ``(out_start, out_len, raw_start, raw_len)``. Runs of plain text have
equal lengths; a decoded escape maps one character to several raw ones, a soft line break none.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Run = tuple[int, int, int, int]
RUNS = "array<struct<out_start:int,out_len:int,raw_start:int,raw_len:int>>"
DECODED = f"struct<text:string,runs:{RUNS}>"

#: What is not plain text: a coded or literal line end, a soft break, an escape. Any other ``=`` stays as it is.
_QUOTED = re.compile(r"(?P<line>=0[Dd]=0[Aa]|\r\n)|(?P<soft>=\r?\n)|=(?P<hex>[0-9A-Fa-f]{2})")
_LINE = re.compile(r"(?P<line>\r\n)")


def _decode(raw: str, pattern: re.Pattern[str]) -> tuple[str, list[Run]]:
    out: list[str] = []
    runs: list[Run] = []
    at = done = 0

    def plain(upto: int) -> None:
        nonlocal at
        if upto > done:
            out.append(raw[done:upto])
            runs.append((at, upto - done, done, upto - done))
            at += upto - done

    for m in pattern.finditer(raw):
        found = m.groupdict()
        text = "\n" if found["line"] else "" if found.get("soft") else chr(int(found["hex"], 16))
        plain(m.start())
        out.append(text)
        runs.append((at, len(text), m.start(), m.end() - m.start()))
        at += len(text)
        done = m.end()
    plain(len(raw))
    return "".join(out), runs


def decode_quoted(raw: str) -> tuple[str, list[Run]]:
    """Lenient quoted-printable decoding; line ends become ``\\n``."""
    return _decode(raw, _QUOTED)


def decode_plain(raw: str) -> tuple[str, list[Run]]:
    return _decode(raw, _LINE)


def decode_body(raw: str, encoding: str | None) -> tuple[str, list[Run]]:
    """By transfer encoding; base64 is an attachment's and stays as it is."""
    return decode_quoted(raw) if (encoding or "").strip().lower() == "quoted-printable" else decode_plain(raw)


def to_raw(runs: list[Run], start: int, end: int, base: int = 0) -> tuple[int, int]:
    """Raw range of a decoded range, snapped outwards to whole escapes."""
    solid = [r for r in runs if r[1]]
    if not solid:
        return base, base
    begins = [r[0] for r in solid]

    def covering(p: int) -> Run:
        return solid[max(bisect_right(begins, p) - 1, 0)]

    a = covering(start)
    first = a[2] + (min(start - a[0], a[1]) if a[1] == a[3] else 0)
    if end <= start:
        return base + first, base + first
    b = covering(end - 1)
    last = b[2] + (end - b[0] if b[1] == b[3] else b[3])
    return base + first, base + last


def _decoded(raw: pd.Series, encoding: pd.Series) -> pd.DataFrame:
    rows = [decode_body(r or "", e) for r, e in zip(raw, encoding, strict=True)]
    names = ("out_start", "out_len", "raw_start", "raw_len")
    return pd.DataFrame({"text": [t for t, _ in rows], "runs": [[dict(zip(names, x, strict=True)) for x in runs] for _, runs in rows]})


def decoded(raw: Column, encoding: Column) -> Column:
    """``struct<text, runs>`` of a raw body."""
    return F.pandas_udf(_decoded, DECODED)(raw, encoding)


def raw_range(runs: Column, start: Column, end: Column, base: Column) -> Column:
    """``to_raw`` on columns, without a UDF."""
    solid = F.filter(runs, lambda r: r["out_len"] > 0)
    cover = lambda p: F.element_at(F.filter(solid, lambda r: r["out_start"] <= p), -1)
    a, b = cover(start), cover(end - 1)
    first = a["raw_start"] + F.when(a["out_len"] == a["raw_len"], F.least(start - a["out_start"], a["out_len"])).otherwise(0)
    last = b["raw_start"] + F.when(b["out_len"] == b["raw_len"], end - b["out_start"]).otherwise(b["raw_len"])
    return F.struct((base + first).alias("raw_start"), (base + F.when(end > start, last).otherwise(first)).alias("raw_end"))


def merged_runs(runs: list[Run]) -> list[Run]:
    """Neighbouring plain runs as one."""
    out: list[Run] = []
    for r in runs:
        if out and r[1] == r[3] == r[1] and r[1] and out[-1][1] == out[-1][3] and out[-1][0] + out[-1][1] == r[0] and out[-1][2] + out[-1][3] == r[2]:
            p = out.pop()
            r = (p[0], p[1] + r[1], p[2], p[3] + r[3])
        out.append(r)
    return out
