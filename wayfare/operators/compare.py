"""Two runs of the same cases, compared: what differs, and whether the comparison proves anything."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGEST = "^[0-9a-f]{16}$"


def mismatches(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, verdict): cases that only one run has, or whose columns differ; nulls equal each other."""
    left = a.select(F.col(key).alias("_a"), *(F.col(c).alias(f"_a_{c}") for c in columns))
    right = b.select(F.col(key).alias("_b"), *(F.col(c).alias(f"_b_{c}") for c in columns))
    same = reduce(Column.__and__, (F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")) for c in columns))
    verdict = F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").when(~same, "differs")
    return left.join(right, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), verdict.alias("verdict")).where("verdict IS NOT NULL")


def compare(a: DataFrame, b: DataFrame, key: str, columns: list[str], digests: list[str], expect: int | None = None) -> DataFrame:
    """One row: cases of both runs, mismatches, and problems: a run without an OK case, of an unexpected length, or without digests."""

    def facts(run: DataFrame, name: str) -> DataFrame:
        ok = F.col("status") == "OK"
        fine = reduce(Column.__and__, (F.coalesce(F.col(c).rlike(DIGEST), F.lit(False)) for c in digests))
        return run.agg(F.count(F.lit(1)).alias(f"n_{name}"), F.count_if(ok).alias(f"ok_{name}"), F.count_if(ok & ~fine).alias(f"bad_{name}"))

    one = facts(a, "a").crossJoin(facts(b, "b")).crossJoin(mismatches(a, b, key, columns).agg(F.count(F.lit(1)).alias("mismatches")))  # single rows
    said = []
    for name in "ab":
        if expect is not None:
            said.append(F.when(F.col(f"n_{name}") != expect, F.format_string(f"{name}: %d cases, expected {expect}", F.col(f"n_{name}"))))
        said.append(F.when(F.col(f"ok_{name}") == 0, f"{name}: no OK case"))
        said.append(F.when(F.col(f"bad_{name}") > 0, f"{name}: no digest"))
    return one.select(F.col("n_a").alias("cases_a"), F.col("n_b").alias("cases_b"), "mismatches", F.array_join(F.array_compact(F.array(*said)), "; ").alias("problems"))
