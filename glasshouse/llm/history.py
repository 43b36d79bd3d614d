"""Versions of a dimension from changes that arrive in any order.

A change concerns one key and starts on a day.  An update states the key's value from that day on, a delete its absence; a
correction states the value of a given number of days and overrules both on them.  A day takes the last-arrived correction that
covers it, else the update or delete with the latest start not after it, of equal starts the last-arrived.  Days without either,
or whose update or delete is a delete, are absent; a null value is a value.  A version is a maximal run of consecutive present
days of equal value (null equals null).

Corrections are exploded into the days they cover and one release day behind them; max_by arrival picks the last-arrived one for each
key and day.  The starts of updates and deletes join them as rows of the same timeline, whose base state is filled forward; lag
finds where the state changes.  A day that is no row of the timeline has the state of the row before it: it starts nothing, and is
neither covered nor released.  Rows are aggregated by key and day before they are shuffled, so a window holds a row for each day that
something happens to a key, however many changes it has.

A change without a key or a start concerns nothing; one of an unknown kind, or a correction of no days (null, zero or
fewer), states nothing.  Changes that arrive together (equal in all arrival columns, repeated rows among them) count by their value, the largest
last and null first; a delete comes before an update.  Texts of values are taken whole.  An empty table gives no versions.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _timeline(changes: DataFrame, arrival: list[str]) -> DataFrame:
    """One row for each key and day on which something starts, is covered or is released: the last-arrived correction and base change of that day."""
    correction = F.col("kind") == "correction"
    day = F.explode(F.when(correction, F.sequence("start", F.col("start") + F.col("days"))).otherwise(F.array("start")))
    known = changes.where("key IS NOT NULL AND start IS NOT NULL AND (kind IN ('update', 'delete') OR kind = 'correction' AND days > 0)")
    rows = known.select("key", day.alias("day"), "kind", "value", F.struct(*arrival, F.col("kind") == "update", "value").alias("arrived"), (F.col("start") + F.col("days")).alias("released"))
    state = F.struct((F.col("kind") != "delete").alias("present"), F.when(F.col("kind") != "delete", F.col("value")).alias("value"))

    def last(of: Column) -> Column:
        return F.max_by(F.when(of, state), F.when(of, F.col("arrived")))

    covering = (F.col("kind") == "correction") & (F.col("day") < F.col("released"))
    return rows.groupBy("key", "day").agg(last(covering).alias("corrected"), last(F.col("kind") != "correction").alias("based"))


def versions(changes: DataFrame, arrival: list[str]) -> DataFrame:
    """key, version, valid_from, valid_to (exclusive; null: endless) and value, from changes(key, start long, kind, days long, value, *arrival).

    kind is 'update', 'delete' or 'correction' (of `days` days, the start included); arrival orders the changes."""
    by_day = Window.partitionBy("key").orderBy("day")
    filled = F.last("based", ignorenulls=True).over(by_day)
    states = _timeline(changes, arrival).select("key", "day", F.coalesce("corrected", filled).alias("state"))
    present = F.coalesce(F.col("state.present"), F.lit(False))
    flat = states.select("key", "day", present.alias("present"), F.col("state.value").alias("value"))
    before = F.lag(F.struct("present", "value")).over(by_day)
    islands = flat.withColumn("before", before).where(F.col("before").isNull() | ~F.struct("present", "value").eqNullSafe(F.col("before")))
    ends = islands.withColumn("valid_to", F.lead("day").over(by_day)).where("present")
    return ends.select("key", F.row_number().over(by_day).alias("version"), F.col("day").alias("valid_from"), "valid_to", "value")


#: The changes that the contract makes of a document: their number, the days they start on, the days of a correction and the documents that share a history.
CHANGES, STARTS, DAYS, SHARED = 2, 60, 10, 10


def document_changes(docs: DataFrame) -> DataFrame:
    """The changes of the contract from documents(doc_id, lang): what they concern, when and how follows from a hash of doc_id and number.

    doc_id - doc_id mod 10 takes the mod that is never negative.  A row without a doc_id changes nothing."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("value"), F.explode(F.array(*[F.lit(j) for j in range(CHANGES)])).alias("j")).where("doc_id IS NOT NULL")
    digest = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("j").cast("string")), 256)
    hashed = rows.withColumn("h", F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"))
    part = F.expr("h div 1000") % 10
    kind = F.when(part <= 1, "delete").when(part <= 4, "correction").otherwise("update")
    return hashed.select((F.col("doc_id") - F.pmod("doc_id", F.lit(SHARED))).alias("key"), (F.col("h") % STARTS).alias("start"), kind.alias("kind"), F.lit(DAYS).cast("long").alias("days"), "value", "h", "doc_id", "j")


ARRIVAL = ["h", "doc_id", "j"]
