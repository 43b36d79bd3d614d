"""Decomposition of every assigned character against Python's."""

import unicodedata

from glasshouse.functions import text as T
from pyspark.sql import functions as F


def test_every_assigned_character(spark):
    chars = [c for c in map(chr, range(1, 0x110000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co")]
    rows = [("".join(chars[i : i + 150]),) for i in range(0, len(chars), 150)] + [(None,), ("",), ("plain",), ("é…ﬁ한글½",)]
    got = spark.createDataFrame(rows, "t string").select("t", T.without_accents(F.col("t")).alias("d")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = None if r.t is None else "".join(c for c in unicodedata.normalize("NFKD", r.t) if not unicodedata.combining(c))
        assert r.d == want, [hex(ord(c)) for c in r.t if "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) not in r.d][:5]
