"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

E-mail addresses, IP addresses, card numbers (Luhn) and phone numbers are the base kinds.
IBANs (mod 97) and social security numbers are added; the latter have no checksum and are taken only when a context word stands
near them. A context word within ``NEAR`` code points before or after a span adds 30 to its score. Only DataFrame functions are used; no row is shuffled.

Patterns carry possessive quantifiers and look-behinds where these leave the matches as they
are, so that long runs of digits or word characters are searched once, not from each position.

Nulls: a null text has no spans. Repeated rows each get their own result. An empty table
gives an empty result. Offsets are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.spans import Kind, base_only, by_kind, count_of, duck_joined, duck_spans, find, joined
from strandmill.session import table


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column, _: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike("^(|[0-9]|[0-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def _card(value: Column, _: Column) -> Column:
    return F.length(digits(value)).between(13, 19) & F.call_function("luhn_check", digits(value))


def _phone(value: Column, _: Column) -> Column:
    return F.length(digits(value)).between(9, 15)


def mod97(value: Column) -> Column:
    """The ISO 7064 remainder of an IBAN: the first four characters go last, letters count from 10."""
    turned = F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4))
    chars = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.ascii(F.substring(turned, i, F.lit(1))))

    def step(rest: Column, c: Column) -> Column:
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(chars, F.lit(0), step)


def _has(words: str):
    return lambda t: F.contains(t, F.lit(words))


#: Code points before and after a span in which context words count.
NEAR = 40
#: The first four are the base kinds; the others are added by this operator.
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", first=_has("@"), score=90, context="e-?mails?|mailto|contact|correo|courriel"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", test=_octets, score=60, context="ip|hosts?|servers?|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", test=_card, score=80, context="cards?|visa|mastercard|credit|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", test=_phone, first=_has("+"), score=70, context="tel|phones?|telephone|call|fax|mobile"),
    Kind("iban", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Z0-9])", test=lambda v, s: mod97(v) == 1, base=False, score=80, context="iban|account|bank|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", base=False, score=40, context="ssn|social security", needs=60),
]


def detect(df: DataFrame, text: str = "text", near: int = NEAR) -> DataFrame:
    """Add ``spans``, with kind, offsets, value and score, ordered by start."""
    return find(df, KINDS, text, near)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents, with counts by kind, the number of all spans and their scores in the same order."""
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", by_kind(F.col("spans")).alias("spans"))
    counts = [count_of(F.col("spans"), k.name).alias(f"n_{k.name}") for k in KINDS]
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores")
    return found.select("doc_id", *counts, F.sha2(joined(base_only(F.col("spans"))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores, F.size("spans").cast("long").alias("n_spans"))


def op8_sql() -> str:
    number = r"regexp_replace({v}, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(1, length({number}) + 1), lambda i:
        CASE WHEN (length({number}) - i) % 2 = 1
             THEN (2 * substr({number}, i, 1)::INT) % 10 + (2 * substr({number}, i, 1)::INT) // 10
             ELSE substr({number}, i, 1)::INT END)) % 10 = 0"""
    turned = "(substr({v}, 5) || substr({v}, 1, 4))"
    digit = f"(CASE WHEN ascii(substr({turned}, i, 1)) >= 65 THEN (ascii(substr({turned}, i, 1)) - 55)::VARCHAR ELSE substr({turned}, i, 1) END)"
    remainder = f"(array_to_string(list_transform(range(1, length({turned}) + 1), lambda i: {digit}), '')::HUGEINT % 97)"
    wide = f"length({number}) BETWEEN 13 AND 19"

    def near(kind: Kind) -> str:
        word = f"'(^|[^a-z0-9])({kind.context})([^a-z0-9]|$)'"
        return f"(regexp_matches(lower(substr(t, greatest(z.s - {NEAR - 1}, 1), least({NEAR}, z.s))), {word}) OR regexp_matches(lower(substr(t, z.e + 1, {NEAR})), {word}))"

    score = "CASE z.nth " + " ".join(f"WHEN {i} THEN {k.score} + CASE WHEN {near(k)} THEN 30 ELSE 0 END" for i, k in enumerate(KINDS)) + " END"
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, "list_max(list_transform(string_split({v}, '.'), lambda p: p::HUGEINT)) <= 255"),
        ("card", r"[0-9]([\x20-]?[0-9])+", 0, f"CASE WHEN {wide} THEN {luhn} ELSE false END"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, f"length({number}) BETWEEN 9 AND 15"),
        ("iban", "[A-Z0-9]+", 0, f"CASE WHEN regexp_full_match({{v}}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') THEN {remainder} = 1 ELSE false END"),
        ("ssn", "[0-9-]+", 0, "regexp_full_match({v}, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND " + near(KINDS[5])),
    ]
    every = [f"s{i}" for i in range(len(kinds))]
    counts = ", ".join(f"len(s{i})::BIGINT AS n_{k[0]}" for i, k in enumerate(kinds))
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    {duck_spans(kinds, "doc_id, t")}
    SELECT doc_id, {counts}, sha256({duck_joined(every[:4], "kind")}) AS base_sha256, {duck_joined(every, "kind")} AS spans,
           array_to_string(list_transform(list_concat({", ".join(every)}), lambda z: {score}), ',') AS scores,
           len(list_concat({", ".join(every)}))::BIGINT AS n_spans FROM f"""
