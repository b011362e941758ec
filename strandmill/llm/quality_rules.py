"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths are computed in numpy over the words of a block of
whole texts. For each length the characters (code points in words) that lie inside n-grams
found twice or more in the same text are measured, and likewise the characters in lines that
repeat an earlier line. No shuffle takes place: a text's verdict depends on it alone.

Nulls: a null text counts as empty (no words, hence rejected by the word floor); other
columns may be null. Repeated rows and ids each get their own row. An empty table gives an
empty result. Memory follows the block size (about 0.5 MB of text) or the longest text. Hashes have 64 bits
and are compared inside one text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandmill.llm.arrays import CHARS, Text, blocks, prefix_sums, repeated, span_hashes, tidy, utf8, windows
from strandmill.session import table


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict; ``coverage`` maps an n-gram length to the share of word characters allowed."""

    min_words: int = 20
    repeat_window: int = 8
    max_repeat_percent: int = 30
    coverage: dict[int, float] = field(default_factory=lambda: {5: 0.36, 8: 0.32, 10: 0.30})
    max_line_chars: float = 0.30
    max_symbols_per_word: float = 0.25


COLUMNS = [
    ("n_words", T.LongType(), pa.int64()),
    ("word_chars", T.LongType(), pa.int64()),
    ("n_symbols", T.LongType(), pa.int64()),
    ("n_dup_lines", T.LongType(), pa.int64()),
    ("n_repeat_words", T.LongType(), pa.int64()),
    ("dup_line_chars", T.LongType(), pa.int64()),
    ("worst_coverage", T.DoubleType(), pa.float64()),
    ("base_failed", T.BooleanType(), pa.bool_()),
    ("kept", T.BooleanType(), pa.bool_()),
]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def _covered(doc: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
    """Words that lie in a window of ``width`` words found twice or more in their text."""
    first, found = windows(hashes, doc, width)
    twice, _ = repeated(doc[first], found)
    edge = np.zeros(len(doc) + 1, np.int32)
    np.add.at(edge, first[twice], 1)
    np.add.at(edge, first[twice] + width, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(data: np.ndarray, off: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """All measures and the verdict for a block of texts given as UTF-8 bytes and offsets."""
    text = Text(data, off)
    n = text.n
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    doc, size = text.doc, points[text.ends] - points[text.starts]
    n_words = text.counts()
    word_chars = np.bincount(doc, size, minlength=n).astype(np.int64)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": _per_text(_SYMBOL[data], off)}

    feeds = np.flatnonzero(data == 0x0A)
    line_start = np.sort(np.concatenate([off[:-1], feeds + 1]), kind="stable")
    line_end = np.sort(np.concatenate([off[1:], feeds]), kind="stable")
    first_word, last_word = np.searchsorted(text.starts, line_start), np.searchsorted(text.starts, line_end)
    worded = last_word > first_word
    line_start, line_end, first_word, last_word = (x[worded] for x in (line_start, line_end, first_word, last_word))
    line_doc = doc[first_word]
    _, later = repeated(line_doc, span_hashes(text.prefix, CHARS, line_start, line_end))
    sums = np.concatenate([[0], np.cumsum(size)])
    line_chars = sums[last_word] - sums[first_word]
    out["n_dup_lines"] = np.bincount(line_doc, later, minlength=n).astype(np.int64)
    out["dup_line_chars"] = np.bincount(line_doc, later * line_chars, minlength=n).astype(np.int64)

    hashes, worst = text.word_hashes(), np.zeros(n)
    bad = np.zeros(n, bool)
    for width in sorted({*rules.coverage, rules.repeat_window}):
        inside = _covered(doc, hashes, width)
        if width == rules.repeat_window:
            out["n_repeat_words"] = np.bincount(doc, inside, minlength=n).astype(np.int64)
        if width in rules.coverage:
            share = np.bincount(doc, inside * size, minlength=n) / np.maximum(word_chars, 1)
            worst = np.maximum(worst, share)
            bad |= share > rules.coverage[width]
    bad |= out["dup_line_chars"] > rules.max_line_chars * word_chars
    bad |= out["n_symbols"] > rules.max_symbols_per_word * n_words
    out["worst_coverage"] = worst
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * n_words)
    out["kept"] = ~(out["base_failed"] | bad)
    return out


def score_quality(df: DataFrame, text: str = "text", keep: list[str] | None = None, rules: Rules = Rules()) -> DataFrame:
    """Columns ``keep`` of ``df`` (those in ``COLUMNS`` excepted) with the measures and the verdict."""
    names = {name for name, _, _ in COLUMNS}
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, kind) for name, kind, _ in COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                found = measure(*utf8(part.column(part.schema.get_field_index(text))), rules)
                arrays = [part.column(part.schema.get_field_index(c)) for c in keep]
                arrays += [pa.array(found[name], kind) for name, _, kind in COLUMNS]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *(name for name, _, _ in COLUMNS)])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(tidy(run), schema)


def keep_good(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``df`` whose text passes all rules, with the columns of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                found = measure(*utf8(part.column(part.schema.get_field_index(text))), rules)
                yield part.filter(pa.array(found["kept"]))

    return df.mapInArrow(tidy(run), df.schema)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return scored.drop("worst_coverage")


def op6_sql(rules: Rules = Rules()) -> str:
    widths = sorted({*rules.coverage, rules.repeat_window})
    steps, joins, bad = [], [], []
    for n in widths:
        steps.append(f"""
        win{n} AS (SELECT rid, i, array_to_string(ws[i:i + {n - 1}], ' ') AS g
                   FROM (SELECT rid, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM d WHERE len(ws) >= {n})),
        dup{n} AS (SELECT rid, g FROM win{n} GROUP BY ALL HAVING count(*) > 1),
        cov{n} AS (SELECT rid, count(*) AS w, sum(length(ws[p])) AS c FROM (
                     SELECT DISTINCT x.rid, x.i + k AS p FROM win{n} x JOIN dup{n} USING (rid, g), range({n}) r(k))
                   JOIN d USING (rid) GROUP BY rid)""")
        joins.append(f"LEFT JOIN cov{n} ON cov{n}.rid = m.rid")
        if n in rules.coverage:
            bad.append(f"coalesce(cov{n}.c, 0) / greatest(word_chars, 1) > {rules.coverage[n]!r}::DOUBLE")
    repeat = f"coalesce(cov{rules.repeat_window}.w, 0)"
    failed = f"(n_words < {rules.min_words} OR 100 * {repeat} > {rules.max_repeat_percent} * n_words)"
    bad.append(f"dup_line_chars > {rules.max_line_chars!r}::DOUBLE * word_chars")
    bad.append(f"n_symbols > {rules.max_symbols_per_word!r}::DOUBLE * n_words")
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    m AS (SELECT rid, doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
                 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    l AS (SELECT rid, sum(n - 1) AS n_dup_lines, sum((n - 1) * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS dup_line_chars
          FROM (SELECT rid, line, count(*) AS n FROM (SELECT rid, unnest(ls) AS line FROM m) GROUP BY ALL) GROUP BY rid),
    {",".join(steps)}
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
           coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, {repeat}::BIGINT AS n_repeat_words,
           coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, {failed} AS base_failed,
           NOT ({failed} OR {" OR ".join(bad).replace("dup_line_chars", "coalesce(dup_line_chars, 0)")}) AS kept
    FROM m LEFT JOIN l ON l.rid = m.rid {" ".join(joins)}"""
