"""Table-shaped text: the longest run of table lines, and proof that a table was generated by a loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a field must look like.
NUMERIC = r"^[-+]?[\d,]+(?:\.\d+)?$"
LABELLED = r"^([A-Z][A-Z0-9]*)-(\d+)$"
MIN_FIELDS, MIN_STRUCTURED, MIN_ROWS = 6, 4, 200
MIN_STEPS, MIN_STRIDE_SHARE = 50, 0.9


def fields(line: Column) -> Column:
    """Fields between runs of two blanks or more; between any blanks if that gives fewer than four."""
    wide = F.filter(F.split(F.trim(line), r"\s{2,}"), lambda p: p != "")
    return F.when(F.size(wide) >= 4, wide).otherwise(F.filter(F.split(F.trim(line), r"\s+"), lambda p: p != ""))


def is_table_row(line: Column) -> Column:
    parts = fields(line)
    structured = F.size(F.filter(parts, lambda p: p.rlike(NUMERIC) | p.rlike(LABELLED) | F.contains(p, F.lit("/"))))
    return (F.size(parts) >= MIN_FIELDS) & (structured >= F.greatest(F.lit(MIN_STRUCTURED), F.floor(F.size(parts) / 2)))


def longest_runs(bodies: DataFrame, uid: str, body: str, min_rows: int = MIN_ROWS, row_test=is_table_row) -> DataFrame:
    """``(uid, first_line, rows)`` of the longest run of table lines, the first of equals; a gaps-and-islands aggregate."""
    lines = bodies.select(uid, F.posexplode(F.split(body, "\n")).alias("line_no", "line"))
    tabular = lines.where(row_test(F.col("line"))).select(uid, "line_no")
    island = F.col("line_no") - F.row_number().over(Window.partitionBy(uid).orderBy("line_no"))
    runs = tabular.withColumn("island", island).groupBy(uid, "island").agg(F.min("line_no").alias("first_line"), F.count("*").alias("rows"))
    best = runs.groupBy(uid).agg(F.max_by(F.struct("first_line", "rows"), F.struct("rows", -F.col("first_line"))).alias("best"))
    return best.select(uid, "best.*").where(F.col("rows") >= min_rows)


def column_proof(cells: DataFrame, keys: list[str]) -> DataFrame:
    """How each column of ``(keys.., col, n, value)`` follows from the row number ``n``.

    Kinds: ``linear`` (one first difference), ``modular`` (a stride with wraps of one modulus), ``constant``,
    ``periodic`` (repeats with a period that divides the length), ``none``. Numbers are decimals with nine places.
    """
    group = [*keys, "col"]
    bare = F.regexp_replace(F.regexp_replace("value", ",", ""), r"^\+", "")
    number = F.when(F.col("value").rlike(NUMERIC), bare).when(F.col("value").rlike(LABELLED), F.regexp_extract("value", LABELLED, 2))
    order = Window.partitionBy(*group).orderBy("n")
    rows = cells.withColumn("num", number.cast("decimal(28,9)")).withColumn("step", F.col("num") - F.lag("num").over(order))
    rows = rows.withColumns({"at": F.row_number().over(order) - 1, "first": F.first("value").over(order), "base": F.first("num").over(order)})
    steps = rows.where("step IS NOT NULL").groupBy(*group, "step").count()
    ranked = Window.partitionBy(*group).orderBy(F.desc("count"), F.desc("step"))
    steps = steps.withColumn("n", F.row_number().over(ranked)).groupBy(*group).agg(
        F.count("*").alias("kinds"),
        F.max(F.when(F.col("n") == 1, F.col("step"))).alias("stride"),
        F.max(F.when(F.col("n") == 1, F.col("count"))).alias("often"),
        F.sum("count").alias("steps"),
        F.collect_set(F.when(F.col("n") > 1, F.col("step"))).alias("others"),
    )
    whole = rows.groupBy(*group).agg(
        F.count("*").alias("rows"), F.count("num").alias("nums"), F.count_distinct("value").alias("distinct_values"),
        F.min("base").alias("base"), F.array_sort(F.collect_list(F.struct("at", "value"))).alias("seq"),
    )
    joined = whole.join(steps, group, "left")
    numeric = (F.col("nums") == F.col("rows")) & (F.col("rows") >= 3)
    linear = numeric & (F.col("kinds") == 1) & (F.col("stride") != 0)
    modulus = F.col("stride") - F.element_at("others", 1)
    wraps = numeric & (F.col("steps") >= MIN_STEPS) & (F.col("kinds") == 2) & (F.col("stride") > 0)
    wraps = wraps & (F.col("often") >= F.col("steps") * MIN_STRIDE_SHARE) & (modulus > F.col("stride"))
    values = F.transform("seq", lambda s: s["value"])
    n = F.col("rows").cast("int")
    divides = F.filter(F.sequence(F.lit(1), F.greatest(F.floor(n / 2), F.lit(1)).cast("int")), lambda p: (n % p == 0) & (p < n))
    repeats = F.filter(divides, lambda p: F.slice(values, p + 1, n - p) == F.slice(values, F.lit(1), n - p))
    period = F.when(n >= 4, F.element_at(repeats, 1))
    kind = (
        F.when(linear, "linear")
        .when(wraps, "modular")
        .when(F.col("distinct_values") == 1, "constant")
        .when(F.size(repeats) > 0, F.when(n >= 4, "periodic").otherwise("none"))
        .otherwise("none")
    )
    return joined.select(*group, "rows", "distinct_values", kind.alias("kind"), F.when(kind == "periodic", period).alias("period"))


def generated(proofs: DataFrame, keys: list[str]) -> DataFrame:
    """A table counts as generated with two linear columns and three signals in all."""
    linear = F.count_if(F.col("kind").isin("linear", "modular"))
    signals = F.count_if(F.col("kind") != "none")
    return proofs.groupBy(*keys).agg(linear.alias("linear_columns"), signals.alias("signals"), ((linear >= 2) & (signals >= 3)).alias("generated"))


def generated_tables(messages: DataFrame, uid: str = "msg_uid", body: str = "body", size: str = "size", least_size: int = 60_000) -> DataFrame:
    """``(uid, first_line, rows, table_start, columns, linear_columns, signals, generated)`` of the table in each large message.

    Only messages of more than ``least_size`` bytes are looked at. A column that fewer than nine in ten rows have is no evidence.
    """
    large = messages.where(F.col(size) > least_size).select(uid, body)
    runs = longest_runs(large, uid, body)
    found = large.join(runs, uid).withColumn("_lines", F.split(body, "\n"))
    before = F.length(F.array_join(F.slice("_lines", F.lit(1), F.col("first_line")), "\n"))
    places = found.select(uid, "first_line", "rows", (before + F.when(F.col("first_line") > 0, 1).otherwise(0)).cast("int").alias("table_start"))
    lines = found.select(uid, "rows", F.posexplode(F.slice("_lines", F.col("first_line") + 1, F.col("rows").cast("int"))).alias("n", "line"))
    cells = lines.select(uid, "n", F.posexplode(fields(F.col("line"))).alias("col", "value"))
    proofs = column_proof(cells, [uid]).join(runs.select(uid, F.col("rows").alias("_all")), uid)
    proofs = proofs.where(F.col("rows") >= 0.9 * F.col("_all"))
    width = cells.groupBy(uid).agg((F.max("col") + 1).alias("columns"))
    return places.join(width, uid).join(generated(proofs, [uid]), uid)
