"""JSON reports as relations: every field at any depth, as VARIANT."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .entity import shared_folder

#: Fields that no report may have, and kinds of source that none may name.
FORBIDDEN_KEYS, FORBIDDEN_KEY_PART = ("demoMode", "usedMockData"), "(?i)uplift"
SOURCE_KEYS, SYNTHETIC = ("source", "sourceType", "provider", "policy"), "(?i)mock|demo|synthetic"


def json_fields(reports: DataFrame, root: str = "response") -> DataFrame:
    """(report_id, path, key, text) of every field and list item at any depth of ``payload``; list items have no key.

    ``text`` is that of a string, else null. A level at a time: its containers are written to the shared folder and opened by the next,
    as deep as they go. A payload that is null or no JSON has no fields.
    """
    spark, where = reports.sparkSession, f"{shared_folder(reports.sparkSession)}/rankforge/{uuid.uuid4().hex}"
    level = reports.select("report_id", F.lit(root).alias("path"), F.try_parse_json("payload").alias("v")).where("v IS NOT NULL")
    out, depth = None, 0
    kind = F.schema_of_variant("v")
    while True:
        inside = level.alias("o").lateralJoin(spark.tvf.variant_explode(F.col("o.v").outer()).alias("i"))
        path = F.concat("o.path", F.when(F.col("i.key").isNotNull(), F.concat(F.lit("."), "i.key")).otherwise(F.concat(F.lit("["), F.col("i.pos").cast("string"), F.lit("]"))))
        found = inside.select("o.report_id", path.alias("path"), "i.key", F.col("i.value").alias("v")).withColumn("kind", kind)
        found.write.parquet(f"{where}/{depth}")
        found = spark.read.schema(found.schema).parquet(f"{where}/{depth}")
        rows = found.select("report_id", "path", "key", F.when(F.col("kind") == "STRING", F.variant_get("v", "$", "string")).alias("text"))
        out = rows if out is None else out.unionByName(rows)
        level = found.where("kind LIKE 'OBJECT%' OR kind LIKE 'ARRAY%'").select("report_id", "path", "v")
        if level.isEmpty():
            return out
        depth += 1


def suspect(payload: Column) -> Column:
    """Whether a JSON text may have a row in ``synthetic_fields``, by its text alone; true for each that has one, null for null.

    Strings that an escape hides (\\uXXXX, or any in a source's own text) are suspect as well.
    """
    sources = rf'"(?:{"|".join(SOURCE_KEYS)})"\s*:\s*"[^"\\]*(?:\\|(?:{SYNTHETIC}))'
    words = [F.contains(payload, F.lit(x)) for x in ("\\u", *FORBIDDEN_KEYS)]  # cheaper than one pattern of all
    return reduce(or_, [*words, payload.rlike(FORBIDDEN_KEY_PART), payload.rlike(sources)])


def synthetic_fields(reports: DataFrame) -> DataFrame:
    """(report_id, path, rule) of fields that no report may have: forbidden keys, and source fields that name something synthetic.

    A forbidden word inside any other text is no violation. Only payloads that are ``suspect`` are opened.
    """
    f = json_fields(reports.where(suspect(F.col("payload"))))
    key = F.col("key").isin(*FORBIDDEN_KEYS) | F.col("key").rlike(FORBIDDEN_KEY_PART)
    source = F.col("key").isin(*SOURCE_KEYS) & F.col("text").rlike(SYNTHETIC)
    rule = F.when(key, "forbidden_field").when(source, "synthetic_source")
    return f.select("report_id", "path", rule.alias("rule")).where("rule IS NOT NULL")
