"""The page segments' plans, and full stops that end no sentence."""

from pyspark.sql import functions as F

from glasshouse.functions import lexicon as L
from glasshouse.functions import text as T
from glasshouse.operators.lines import rebuild


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_found_once(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>")], "page_id long, html string")
    assert plan(T.segments_of_sites(pages, "page_id", "html")[0])[0].count("noscript") == 1


def test_lines_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    assert plan(rebuild(docs, "doc_id"))[1].count("Exchange ") == 1


def test_full_stops_inside_sentences(spark):
    """As the patterns that begin with a boundary mark them."""
    words = "|".join(sorted(L.ABBREVIATIONS, key=len, reverse=True))
    before = ((rf"(?iuU)\b({words})\.", "$1\u0001"), (rf"(?U)\b([{L.UPPER}])\.", "$1\u0001"), (r"(\d)\.(?=\d)", "$1\u0001"))
    texts = ["Dr. A. Silva art. 5.1.2. Fim. Outra", "A.B.C. D", "xdr. Dr.art.Inc.. B", "nº. 1.2.x 3..4 NO.No.nO. Z", "ÉX. É. éx. ex.É.", "dr.", ".", "", "a.1.B. 𝒜. 12.3.4.", "\u0001art.\u0001A.", "_A. _art. -A. -art. I. İ. ſr. SR."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.filter(F.transform(F.split(F.replace(T.replace_all(F.col("t"), *before, (rf"(?<=[.!?;:])\s+(?=[{L.UPPER}])", "\n"), (rf"\s+(?=\d+(?:\u0001\d+)*[).]\s+[{L.UPPER}])", "\n"), (rf"\s+(?={L.BRACKET_MARK}\s)", "\n")), F.lit("\u0001"), F.lit(".")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    for r in rows.select("t", old.alias("old"), T.sentences(F.col("t")).alias("new")).collect():
        assert r.old == r.new, r.t
