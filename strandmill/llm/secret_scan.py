"""Secret scans with corpus-wide ownership.

Patterns propose candidates in whole texts. The hash of each candidate's value is aggregated
over the corpus by distinct repositories and owners: a value that ``EXAMPLE_OWNERS`` owners or more carry is a
widely copied example; one that a single owner carries in fewer than ``COPIED_REPOS`` repositories and that looks random is a
live-looking credential; the rest (two owners, an owner's own boilerplate, flat values) is shared. Redaction leaves only widely copied examples.
Only DataFrame functions are used. A repository is known by its owner and its id; by default each document is one.

Texts are read once and not shuffled; what travels are candidates. The counts are partial
sums over (value, owner, repository), one row a value, and are joined back without salt: a value
that a third of all documents hold is one row on that side, so adaptive execution can split the other.

Nulls: a null text has no spans; a null owner or repository counts as one of its own. Repeated rows each get
their own result. An empty table gives an empty result. Values are compared by 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.spans import Kind, base_only, count_of, duck_joined, duck_spans, find, joined
from strandmill.session import durable, ship, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PEM_HEADER = "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
#: From the header through the END line, or to the end of the base64 lines where there is none. Keys share headers, so the body must be in the value.
PEM = PEM_HEADER + (
    r"(?:[^-]*+(?:-(?!----)[^-]*+){0,16}+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?:\s*+[A-Za-z-]++:[^\n]*+\n){0,4}+(?:(?:\s|\\[nr]){0,8}+[A-Za-z0-9+/=]{16,}+){1,400}+(?:(?:\s|\\[nr]){1,8}+[A-Za-z0-9+/]{1,15}+={0,2}+(?=\s*+$|[\x20\t\r]*+\n|\\[nr]|[\"']))?+)"
)
#: The first three are the base kinds; the others are added by this operator.
KINDS = [
    Kind("assign", ASSIGN, 2, lambda v, s: F.length(v) >= 6),
    Kind("access", "AKIA[A-Z0-9]{16,}", first=lambda t: F.contains(t, F.lit("AKIA"))),
    Kind("hex", "[0-9a-f]{24,}+"),
    Kind("forge", "gh[pousr]_[A-Za-z0-9]{36,}+", first=lambda t: t.rlike("gh[pousr]_"), base=False),
    Kind("chat", "xox[abprs]-[A-Za-z0-9-]{10,}+", first=lambda t: F.contains(t, F.lit("xox")), base=False),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", first=lambda t: F.contains(t, F.lit("eyJ")), base=False),
    Kind("pem", PEM, first=lambda t: F.contains(t, F.lit("PRIVATE KEY")), base=False),
]
EXAMPLE_OWNERS = 3
COPIED_REPOS = 8
LIVE_CHARACTERS = 8


def verdict(owners: Column, repos: Column, value: Column) -> Column:
    """``example``, ``live`` or ``shared`` from the numbers of owners and repositories and the look of the value."""
    variety = F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("."), F.lit(0))))
    own = (owners == 1) & (repos < COPIED_REPOS) & (variety >= LIVE_CHARACTERS)
    return F.when(owners >= EXAMPLE_OWNERS, "example").when(own, "live").otherwise("shared")


def ownership(candidates: DataFrame) -> DataFrame:
    """``(value_hash, repos, owners)`` from ``(value_hash, owner, repo)``."""
    by_owner = candidates.distinct().groupBy("value_hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("value_hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"))


def judge(slim: DataFrame) -> DataFrame:
    """Add ``verdicts``, ``owners`` and ``repos``, one for each of ``spans``, to a table with ``rid`` (unique), ``owner``, ``repo`` and ``spans``."""
    each = slim.where(F.size("spans") > 0).select("rid", "owner", "repo", F.posexplode("spans").alias("nth", "span"))
    each = each.select("rid", "owner", "repo", "nth", F.col("span.value").alias("value"), F.xxhash64("span.value").alias("value_hash"))
    counts = ownership(each.select("value_hash", "owner", "repo"))
    one = F.struct("nth", verdict(F.col("owners"), F.col("repos"), F.col("value")).alias("verdict"), "owners", "repos")
    judged = each.join(counts, "value_hash").select("rid", one.alias("one"))
    lists = judged.groupBy("rid").agg(F.array_sort(F.collect_list("one")).alias("judged"))
    joined_ = slim.drop("owner", "repo").join(lists, "rid", "left")
    kinds = {"verdict": "array<string>", "owners": "array<bigint>", "repos": "array<bigint>"}
    # a field of an array of structs is the array of that field
    made = [F.coalesce(F.col(f"judged.{c}"), F.array().cast(kind)).alias(c) for c, kind in kinds.items()]
    return joined_.select(*joined_.columns, *made).drop("judged").withColumnRenamed("verdict", "verdicts")


def scan(df: DataFrame, keep: list[str], text: str = "text", owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """``keep`` of every row with ``spans`` and their ``verdicts``, ``owners`` and ``repos``; texts are dropped before any shuffle."""
    found = find(df.select(*dict.fromkeys([*keep, text, owner, repo])), KINDS, text)
    own = F.struct(F.col(owner).alias("owner"), F.col(repo).alias("repo"))
    slim = found.select(F.struct(*keep).alias("kept"), own["owner"].alias("owner"), own["repo"].alias("repo"), "spans")
    slim = durable(slim.withColumn("rid", F.monotonically_increasing_id()))
    return judge(slim).select("kept.*", "spans", "verdicts", "owners", "repos")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents, with counts, verdicts by ownership and the widest ownership of a document's values."""
    found = scan(table(spark, sf_dir, "documents"), ["doc_id"])
    counts = [count_of(F.col("spans"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    of = lambda v: F.size(F.filter("verdicts", lambda x: x == v)).cast("long")
    most = lambda c: F.coalesce(F.array_max(c), F.lit(0)).cast("long").alias(f"max_{c}")
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(base_only(F.col("spans"))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        of("live").alias("n_live"),
        of("example").alias("n_example"),
        most("owners"),
        most("repos"),
    )


MARK = "[REDACTED]"


def redact_secrets(docs: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with every candidate replaced by ``MARK`` that is not a widely copied example.

    Neither the look of a value nor a second owner spares it: short values can never look random.
    Texts without candidates pass straight through; only those with candidates are written and joined.
    """
    ship(docs.sparkSession)
    found = find(docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("_body")), KINDS, "_body")
    clean = found.where(F.size("spans") == 0).select("row.*")
    slim = found.where(F.size("spans") > 0).select(
        "row", F.col(f"row.{owner}").alias("owner"), F.col(f"row.{repo}").alias("repo"), "spans", F.monotonically_increasing_id().alias("rid")
    )
    slim = durable(slim)
    judged = judge(slim.drop("row"))
    secret = F.filter(F.arrays_zip("spans", "verdicts"), lambda x: x["verdicts"] != "example")
    cuts = judged.select("rid", F.array_sort(F.transform(secret, lambda x: F.struct((x["spans"]["end"] - F.length(x["spans"]["value"])).alias("a"), x["spans"]["end"].alias("b")))).alias("cuts"))
    body = F.col(f"row.{text}")

    def step(state: Column, cut: Column) -> Column:
        fresh = cut["a"] >= state["at"]
        more = F.when(fresh, F.concat(state["out"], F.substring(body, state["at"] + 1, cut["a"] - state["at"]), F.lit(MARK)))
        return F.struct(F.coalesce(more, state["out"]).alias("out"), F.greatest(state["at"], cut["b"]).alias("at"))

    whole = F.aggregate(
        "cuts",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        step,
        lambda state: F.concat(state["out"], F.substring(body, state["at"] + 1, F.length(body))),
    )
    changed = slim.select("rid", "row").join(cuts, "rid").withColumn("_body", whole)
    return clean.unionByName(changed.select(*[F.col("_body").alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in docs.columns]))


def op4_sql() -> str:
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    names = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    kinds = [
        ("assign", rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, "length({v}) >= 6"),
        ("access", "AKIA[A-Z0-9]+", 0, "length({v}) >= 20"),
        ("hex", "[0-9a-f]{24,}", 0, "true"),
        *((k.name, k.pattern.replace("}+", "}"), 0, "true") for k in KINDS[3:-1]),
        # the SQL knows a key by its header only
        ("pem", PEM_HEADER, 0, "true"),
    ]
    every = [f"s{i}" for i in range(len(kinds))]
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
    {duck_spans(kinds, "rid, doc_id, source")},
    c AS (SELECT rid, doc_id, source, unnest(list_concat({", ".join(every)})).v AS v FROM f),
    o AS (SELECT v, count(DISTINCT source) + max((source IS NULL)::INT) AS owners, count(DISTINCT {{'o': source, 'r': doc_id}}) AS repos FROM c GROUP BY v),
    n AS (SELECT rid, max(owners) AS max_owners, max(repos) AS max_repos,
                 count(*) FILTER (owners = 1 AND repos < {COPIED_REPOS} AND len(list_distinct(regexp_extract_all(v, '.'))) >= {LIVE_CHARACTERS}) AS n_live,
                 count(*) FILTER (owners >= {EXAMPLE_OWNERS}) AS n_example FROM c JOIN o USING (v) GROUP BY rid)
    SELECT doc_id, len(s0)::BIGINT AS n_assign, len(s1)::BIGINT AS n_access, len(s2)::BIGINT AS n_hex,
           sha256({duck_joined(every[:3], "start")}) AS base_sha256, {duck_joined(every, "start")} AS spans,
           coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example,
           coalesce(max_owners, 0)::BIGINT AS max_owners, coalesce(max_repos, 0)::BIGINT AS max_repos
    FROM f LEFT JOIN n USING (rid)"""
