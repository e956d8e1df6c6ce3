"""Joins of a large side, one key of which may hold a third of its rows, with a small one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks over which one key of the large side is dealt.
SALTS = 16


def salted_join(large: DataFrame, small: DataFrame, keys: Sequence[str], by: Sequence[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``large`` joined by ``keys`` (inner or left): a hash of its columns ``by`` deals equal keys over ``salts`` tasks.

    Each row of ``small`` is repeated ``salts`` times, so it should be smaller than ``large`` by more than that. Spark may still
    broadcast it where its size allows. Null keys match nothing; in a left join they are dealt out like others.
    """
    dealt = large.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")
