"""Lines of extracted documents put back into sentences, as expressions over (document, line) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glasshouse.functions import lexicon as L
from glasshouse.functions.text import clean, recurrent_lines

_WHOLE_MARK = L.ITEM_MARK.removeprefix("^")


def line_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, idx, text: the lines that are not blank, trimmed."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[\s ]+|[\s ]+$", "")), lambda x: x != "")
    return docs.select(key, F.posexplode(lines).alias("idx", "text"))


def rebuild(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and `parts`: the document's rebuilt parts in order.

    Short lines that recur go first.  A part begins at an item mark and after a line that ends a sentence, unless that line is a mark
    and nothing else; its lines are joined by a space, or without the hyphen that a line ends in."""
    whole = docs.select(key, text).repartition(key)  # texts are shuffled once, and their lines not again
    lines = recurrent_lines(line_rows(whole, key, text), key).where("keep")
    order = Window.partitionBy(key).orderBy("idx")
    marked = F.col("text").rlike(L.ITEM_MARK)
    ends = F.col("text").rlike(r"[.!?;]\s*$") & ~F.col("text").rlike(f"^(?:{_WHOLE_MARK})$")
    begins = marked | F.coalesce(F.lag(ends).over(order), F.lit(False))
    parts = lines.withColumn("part", F.sum(begins.cast("int")).over(order)).groupBy(key, "part").agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("lines"))

    def joined(so_far, line):
        return F.when(so_far == "", line["text"]).when(so_far.endswith("-"), F.concat(F.substring(so_far, F.lit(1), F.char_length(so_far) - 1), line["text"])).otherwise(F.concat(so_far, F.lit(" "), line["text"]))

    whole = parts.select(key, "part", clean(F.aggregate("lines", F.lit(""), joined)).alias("text"))
    found = whole.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("p"))
    return found.select(key, F.filter(F.transform("p", lambda x: x["text"]), lambda x: x != "").alias("parts"))
