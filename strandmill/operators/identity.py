"""People from addresses: display names and directory names link addresses of one person."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.text import display_key, name_tokens, sha_short
from strandmill.operators.graph import connected_components


def display_links(senders: DataFrame) -> DataFrame:
    """Addresses seen under one display name of two or more words; each links to the least of them."""
    named = senders.select("address", display_key(F.col("display")).alias("key")).where(F.contains("key", F.lit(" "))).distinct()
    least = named.groupBy("key").agg(F.min("address").alias("src"))
    return named.join(least, "key").where("address <> src").select("src", F.col("address").alias("dst")).distinct()


def directory_links(addresses: DataFrame) -> DataFrame:
    """``x500:`` names that abbreviate a real address: at most two initials and a surname of three or more letters.

    The longest surname wins, then the least address, so the result does not depend on any order.
    """
    names = addresses.where(F.col("address").startswith("x500:")).select("address", F.expr("substring(address, 6)").alias("cn"))
    cuts = names.select("address", "cn", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("cut"))
    cuts = cuts.select("address", F.substring("cn", F.lit(1), F.col("cut")).alias("initial"), F.expr("substring(cn, cut + 1)").alias("surname"), (F.length("cn") - F.col("cut")).alias("long"))
    # a whole name is no abbreviation: at least one initial stands before the surname
    cuts = cuts.where((F.col("long") >= 3) & (F.length("initial") >= 1))
    real = addresses.where(F.contains("address", F.lit("@")) & ~F.col("address").startswith("x500:"))
    real = real.select(F.col("address").alias("real"), name_tokens(F.col("address")).alias("tokens"))
    met = cuts.join(real.select("real", "tokens", F.explode("tokens").alias("surname")), "surname")
    met = met.where(F.exists("tokens", lambda t: t.startswith(F.col("initial"))))
    best = Window.partitionBy("address").orderBy(F.desc("long"), "real")
    return met.withColumn("n", F.row_number().over(best)).where("n = 1").select(F.col("real").alias("src"), F.col("address").alias("dst"))


def resolve(addresses: DataFrame, senders: DataFrame) -> DataFrame:
    """``(address, root)``: the least address of each person.

    ``addresses`` holds all of them, ``senders`` those with display names; both have ``address``.
    """
    every = addresses.select("address").where("address <> ''").distinct()
    edges = display_links(senders).unionByName(directory_links(every))
    found = connected_components(edges)
    joined = every.join(found.withColumnRenamed("vertex", "address"), "address", "left")
    return joined.select("address", F.coalesce("component", "address").alias("root"))


def people(resolved: DataFrame, senders: DataFrame) -> DataFrame:
    """One row a person: id, canonical address (the shortest real one), addresses, display names and messages sent.

    ``senders`` has a row a message, with ``address`` and ``display``. At most six names are listed, in order of the
    alphabet; ``label`` is the longest of these, or the address.
    """
    counts = senders.groupBy("address").agg(F.count("*").alias("messages"), F.collect_set(F.trim(F.regexp_replace("display", r"(?s)</.*$", ""))).alias("names"))
    real = F.contains("address", F.lit("@")) & ~F.col("address").startswith("x500:")
    shortest = F.min(F.when(real, F.struct(F.length("address").alias("n"), "address")))["address"]
    grouped = resolved.join(counts, "address", "left").groupBy("root").agg(
        F.coalesce(shortest, F.min("address")).alias("canonical_address"),
        F.array_sort(F.collect_set("address")).alias("addresses"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), 1, 6).alias("display_names"),
        F.sum(F.coalesce("messages", F.lit(0))).alias("message_count"),
    )
    longest = F.array_min(F.transform("display_names", lambda n: F.struct((-F.length(n)).alias("long"), n.alias("name"))))["name"]
    # an id by hash, since shortened addresses of two people may be alike
    pid = sha_short("p_", F.col("canonical_address"), 12)
    return grouped.select(pid.alias("person_id"), "root", "canonical_address", "addresses", "display_names", F.coalesce(longest, "canonical_address").alias("label"), "message_count")


def to_people(rows: DataFrame, column: str, address_to_person: DataFrame) -> DataFrame:
    """Replace an address column by person ids where one is known."""
    known = address_to_person.select(F.col("address").alias(column), "person_id")
    return rows.join(known, column, "left").withColumn(column, F.coalesce("person_id", column)).drop("person_id")
