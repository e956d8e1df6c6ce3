"""Registrable domains by a table of public suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import TWO_LABEL_SUFFIXES, domain_root, without_www
from .joins import SALTS, salted_join


def default_suffixes(spark: SparkSession) -> DataFrame:
    """The suffixes that the column function ``domain_root`` knows too, as rows."""
    return spark.createDataFrame([(s,) for s in TWO_LABEL_SUFFIXES], "rule string")


def registrable_domains(hosts: DataFrame, suffixes: DataFrame, salts: int = SALTS) -> DataFrame:
    """(host, root) of the distinct hosts: one label more than the longest public suffix, or the whole host if it has none.

    suffixes: rule, as in public suffix lists: ``co.uk``; ``*.ck`` for any one label under ``ck``; ``!www.ck`` for an exception,
    which is registrable itself and outranks every other rule. Rules and hosts are compared without case, a leading ``www.`` and a
    closing dot. A host that no rule meets has the root that ``domain_root`` gives. Null hosts are left out; an empty one is its
    own root. Each suffix of a host's labels meets the rules by equality, so the work is labels, however many rules there are;
    a suffix that most hosts share is dealt over ``salts`` tasks.
    """
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\.$", "")
    labels = F.split(without_www(plain(F.col("host"))), r"\.")
    h = hosts.select("host").where("host IS NOT NULL").distinct().withColumn("labels", labels)
    last = lambda k: F.array_join(F.slice("labels", -k, k), ".")
    parts = h.select("host", F.size("labels").alias("of"), F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("k"), "labels").select("host", "of", "k", last(F.col("k")).alias("suffix"))
    rule = plain(F.col("rule"))
    kind = F.when(rule.startswith("!"), 2).when(rule.startswith("*."), 1).otherwise(0)
    rules = suffixes.where("rule IS NOT NULL").select(F.regexp_replace(rule, r"^(!|\*\.)", "").alias("suffix"), kind.alias("kind")).distinct()
    met = salted_join(parts, rules, ["suffix"], ["host"], salts=salts)
    length: Column = F.col("k") + F.when(F.col("kind") == 1, 1).when(F.col("kind") == 2, -1).otherwise(0)
    met = met.where("kind <> 1 OR of > k")  # a star needs a label to stand for
    best = met.groupBy("host").agg(F.max(F.struct((F.col("kind") == 2).alias("exception"), length.alias("n"))).alias("best"))
    root = F.when(F.col("best").isNull(), domain_root(plain(F.col("host")))).otherwise(last(F.least(F.size("labels"), F.col("best.n") + 1)))
    return h.join(best, "host", "left").select("host", root.alias("root"))
