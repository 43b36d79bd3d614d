"""Nearest marks: an as-of join in both directions on sorted places.

Points and anchors are rows of one sequence.  Within a stretch of CHUNK places of a key the last anchor before and the next one behind a point
are carried by one sorted pass each; what lies in other stretches comes over the stretch's ends, one row for each stretch.  So a key with
very many places is spread over its stretches, and no pair of a point and an anchor that is not nearest is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places in a stretch.
CHUNK = 1 << 16


def starts(text: Column, pattern: str) -> Column:
    """Where the matches of a pattern start, from 0: what lies between matches and the matches themselves, measured and added up.  The pattern must not match nothing."""
    # zipped, the text is split once and not again for every match; behind the last match there is a gap only
    pieces = F.filter(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.char_length(m).alias("own"))), lambda x: x["own"].isNotNull())
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at"))
    return F.aggregate(pieces, zero, lambda s, x: F.struct((s["end"] + x["gap"] + x["own"]).alias("end"), F.array_append(s["at"], s["end"] + x["gap"]).alias("at")))["at"]


def nearest(points: DataFrame, anchors: DataFrame, key: str = "site", at: str = "at") -> DataFrame:
    """points with `before` and `after`, the nearest anchor's place at or before and at or behind each, and `distance`, the lesser of the two; null where there is none.

    A null key has no anchors, a null place none near.  Repeated points stay; other columns of points are kept."""
    stretch = F.floor(F.col("_at") / CHUNK)
    place = anchors.select(F.col(key).alias("_key"), F.col(at).cast("long").alias("_at")).where("_key IS NOT NULL AND _at IS NOT NULL").distinct().withColumn("_part", stretch)
    row = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    asked = points.select(F.col(key).alias("_key"), F.col(at).cast("long").alias("_at"), row.alias("_row")).withColumn("_part", stretch)
    both = asked.unionByName(place.withColumn("_anchor", F.col("_at")), allowMissingColumns=True)
    within = Window.partitionBy("_key", "_part")
    # at one place the anchors come first in either direction
    first = F.col("_row").isNotNull()
    near = both.withColumn("_before", F.last("_anchor", ignorenulls=True).over(within.orderBy("_at", first).rowsBetween(Window.unboundedPreceding, 0)))
    near = near.withColumn("_after", F.last("_anchor", ignorenulls=True).over(within.orderBy(F.desc("_at"), first).rowsBetween(Window.unboundedPreceding, 0))).where(first)
    ends = place.groupBy("_key", "_part").agg(F.min("_at").alias("low"), F.max("_at").alias("high"))
    parts = asked.select("_key", "_part").where("_key IS NOT NULL").distinct().join(ends, ["_key", "_part"], "full")
    over = Window.partitionBy("_key")
    ahead = F.last("high", ignorenulls=True).over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    behind = F.last("low", ignorenulls=True).over(over.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))
    carried = parts.select("_key", "_part", ahead.alias("_ahead"), behind.alias("_behind"))  # a row for each stretch
    found = near.join(carried, ["_key", "_part"], "left")
    before, after = F.coalesce("_before", "_ahead"), F.coalesce("_after", "_behind")
    return found.select("_row.*", before.alias("before"), after.alias("after"), F.least(F.col("_at") - before, after - F.col("_at")).alias("distance"))


def marks(pages: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """key, kind, at: where each kind's pattern matches in the text."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), starts(F.col(text), p).alias("places")) for k, p in patterns.items()])
    return pages.select(key, F.explode(kinds).alias("m")).select(key, "m.kind", F.explode("m.places").alias("at"))


def near_marks(pages: DataFrame, key: str, text: str, patterns: dict[str, str], anchor: str, width: int) -> DataFrame:
    """key, kind, n, near, distance: for each kind of mark of a page its number, how many lie within `width` of an anchor, and the least distance."""
    found = marks(pages, key, text, patterns | {"": anchor})
    placed = nearest(found.where("kind != ''"), found.where("kind = ''"), key)
    return placed.groupBy(key, "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("distance") <= width).alias("near"), F.min("distance").alias("distance"))
