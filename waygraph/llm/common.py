"""What several operators need: shared storage, column checks, span columns."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.plans.storage import discard, shared_dir, stored

__all__ = ["discard", "free", "joined", "matches", "only", "shared_dir", "stored", "swept"]


def swept(spark: SparkSession) -> None:
    """Lets executors drop the shuffle files of steps that are done and stored.

    Spark drops them when the driver finds their plans in its garbage, by itself every
    half hour; a step that moves much data is better begun without them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, without regard to whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer until ``df`` has no such columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def matches(text: Column, pattern: str, groups: int = 0, likely: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,body>>, JVM only.

    ``pattern`` is a Java pattern. The pieces between matches give the positions:
    a match starts after all earlier pieces and matches. Code points, end exclusive.
    ``body`` is capture group ``groups`` (0: the whole match). ``likely`` is a cheap
    test that every text with a match passes; without it the pattern is tried first.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = whole if groups == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(groups))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    parts = F.arrays_zip(
        gaps.alias("gap"),
        F.transform(whole, lambda m: F.length(m)).alias("len"),
        inner.alias("body"),
    )
    empty = F.expr("cast(array() as array<struct<start:int,end:int,body:string>>)")
    folded = F.aggregate(
        F.filter(parts, lambda p: p["len"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + p["len"]).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + p["gap"]).alias("start"),
                        (acc["at"] + p["gap"] + p["len"]).alias("end"),
                        p["body"].alias("body"),
                    )
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    likely = F.regexp_like(text, F.lit(pattern)) if likely is None else likely
    return F.when(likely, folded).otherwise(empty)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of array<struct<kind,start,end,...>>, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )
