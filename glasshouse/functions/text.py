"""Text preparation as column expressions: all JVM-side, inside whole-stage codegen where Spark allows it."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glasshouse.functions import lexicon as L

_MARK = "\u0001"


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters that compatibility decomposition without combining marks makes one other (or none, at the end), what it makes them, and those that become several; Hangul apart."""
    one, several = {}, {}
    for code in range(0x110000):
        char = chr(code)
        if unicodedata.category(char) in ("Cn", "Cs", "Co") or 0xAC00 <= code < 0xAC00 + 11172:
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if base != char:
            (several if len(base) > 1 else one)[char] = base
    order = sorted(one, key=lambda c: one[c] == "")  # what goes stands behind what is replaced
    return "".join(order), "".join(one[c] for c in order), several


def _ranges(codes: list[int], gap: int = 16) -> str:
    """A class of characters that holds the codes, and some between near ones."""
    out: list[list[int]] = []
    for c in sorted(codes):
        if out and c - out[-1][1] <= gap:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out) + "]"


def replace_all(col: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), pairs, col)


def clean(col: Column) -> Column:
    """Control characters and white space of any length to one space, trimmed."""
    return F.trim(replace_all(col, (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "), (r"[\s\u00a0]+", " ")))


def without_accents(col: Column) -> Column:
    """Compatibility decomposition without combining marks, of every character that Python's Unicode tables assign.

    Texts of ASCII stay as they are.  Most characters become one other, which one translation does; texts with characters that become several are taken apart, and those
    are looked up (Hangul syllables by their arithmetic).  Whether a text has any of them is asked of a table of characters, as a pattern tries its ranges one by one for each
    character."""
    before, after, several = _decompositions()
    kind = _ranges([*map(ord, several), 0xAC00, *range(0xAC00, 0xAC00 + 11172, 16), 0xAC00 + 11171])
    known = F.str_to_map(F.lit("\u0001".join(f"{k}\u0002{v}" for k, v in several.items())), F.lit("\u0001"), F.lit("\u0002"))
    jamo = lambda first, n: "".join(map(chr, range(first, first + n)))

    def apart(c: Column) -> Column:
        place = F.ascii(c) - 0xAC00
        lead, vowel, tail = F.floor(place / 588).cast("int"), (F.floor(place / 28) % 21).cast("int"), (place % 28).cast("int")
        pick = lambda letters, at: F.substring(F.lit(letters), at + 1, F.lit(1))
        syllable = F.concat(pick(jamo(0x1100, 19), lead), pick(jamo(0x1161, 21), vowel), F.when(tail > 0, pick(jamo(0x11A8, 27), tail - 1)).otherwise(""))
        return F.when(~c.rlike(kind), c).when((place >= 0) & (place < 11172), syllable).otherwise(F.coalesce(F.element_at(known, c), c))

    ascii_only = lambda c: F.octet_length(c) == F.char_length(c)
    composed = "".join(several) + "".join(map(chr, range(0xAC00, 0xAC00 + 11172)))

    def decomposed(plain: Column) -> Column:
        has = ~ascii_only(plain) & (F.char_length(F.translate(plain, composed, "")) < F.char_length(plain))
        return F.when(has, F.array_join(F.transform(F.split(plain, ""), apart), "")).otherwise(plain)

    # bound to a lambda's variable, a text is translated once
    return F.transform(F.array(col), lambda c: F.when(ascii_only(c), c).otherwise(F.transform(F.array(F.translate(c, before, after)), decomposed)[0]))[0]


def normalise(col: Column) -> Column:
    """Without accents, white space collapsed, lower case; punctuation stays."""
    return F.lower(F.trim(F.regexp_replace(without_accents(col), r"[\s\u00a0]+", " ")))


def normalise_words(col: Column) -> Column:
    """Without accents, lower case, anything but word characters to one space."""
    return F.trim(F.regexp_replace(F.lower(without_accents(col)), r"(?U)[^\w]+", " "))


def normalise_ascii(col: Column) -> Column:
    """Without accents, lower case, only a-z, 0-9 and single spaces."""
    return F.trim(replace_all(F.lower(without_accents(col)), (r"[^a-z0-9 ]+", " "), (" +", " ")))


_BLOCK_TAGS = "address|article|aside|blockquote|br|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|summary|table|tbody|td|tfoot|th|thead|tr|ul|body|html"


def html_blocks(html: Column) -> Column:
    """Visible text of markup as an array of blocks, by patterns (the parser-based form is in html.py)."""
    text = replace_all(
        html,
        (r"\s+", " "),
        (r"(?is)<(script|style|head|noscript|svg|template)\b[^>]*>.*?</\1\s*>", " "),
        (r"(?s)<!--.*?-->", ""),
        (rf"(?i)</?({_BLOCK_TAGS})\b[^>]*>", "\n"),
        (r"<[^>]*>", " "),
    )
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.filter(F.transform(F.split(text, "\n"), clean), lambda x: x != "")


def sentences(block: Column) -> Column:
    """A cleaned block as an array of sentences."""
    words = "|".join(sorted(L.ABBREVIATIONS, key=len, reverse=True))
    marked = replace_all(
        block,
        # the full stop is looked for first, as a pattern that begins with a boundary is tried at every character
        (rf"(?iuU)\.(?<=\b(?:{words})\.)", _MARK),
        (rf"(?U)\.(?<=\b[{L.UPPER}]\.)", _MARK),
        (r"\.(?<=\d\.)(?=\d)", _MARK),
        (rf"(?<=[.!?;:])\s+(?=[{L.UPPER}])", "\n"),
        (rf"\s+(?=\d+(?:{_MARK}\d+)*[).]\s+[{L.UPPER}])", "\n"),
        (rf"\s+(?={L.BRACKET_MARK}\s)", "\n"),
    )
    return F.filter(F.transform(F.split(F.replace(marked, F.lit(_MARK), F.lit(".")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def segments(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, idx, text: the sentences of a page in order."""
    flat = F.flatten(F.transform(html_blocks(F.coalesce(F.col(html), F.lit(""))), sentences))
    return pages.select(F.col(key), F.posexplode(flat).alias("idx", "text"))


def segments_of_sites(pages: DataFrame, key: str, html: str, keep: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """key, idx, text: the sentences of the pages in the own language; and the keys of the pages that were left out.

    `keep` decides on the joined blocks of a page (column `body`); all pages stay if it is a true literal."""
    found = F.array(html_blocks(F.coalesce(F.col(html), F.lit(""))))  # exploded, the blocks are found once and not again for every part of the condition
    blocks = pages.select(key, F.explode(found).alias("blocks")).withColumn("body", F.array_join("blocks", " "))
    own = is_own_language(F.col("body")) if keep is None else keep
    return blocks.where(own).select(key, F.posexplode(F.flatten(F.transform("blocks", sentences))).alias("idx", "text")), blocks.where(~own).select(key)


def segments_of_parts(docs: DataFrame, key: str, parts: str = "parts") -> DataFrame:
    """key, idx, text: the sentences of rebuilt parts (the text layer of PDF documents)."""
    return docs.select(key, F.posexplode(F.flatten(F.transform(parts, sentences))).alias("idx", "text"))


def useful(segs: DataFrame, key: str, least: int = L.MIN_SEGMENT) -> DataFrame:
    """Adds is_useful: long enough and the first of its text within the key."""
    place = F.row_number().over(Window.partitionBy(key, "text").orderBy("idx"))
    return segs.withColumn("is_useful", (F.char_length("text") >= least) & (place == 1))


def offsets(segs: DataFrame, key: str) -> DataFrame:
    """Character intervals of the segments in the normalised document, which joins the non-empty ones by one character."""
    before = Window.partitionBy(key).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    size = F.filter(F.array(F.char_length(normalise(F.col("text")))), lambda n: n > 0)  # exploded, it is found once and not again for the condition and the sum
    rows = segs.select("*", F.explode(size).alias("_size")).withColumn("begin", F.coalesce(F.sum(F.col("_size") + 1).over(before), F.lit(0)))
    return rows.withColumn("end", F.col("begin") + F.col("_size")).drop("_size")


def language_hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(rf"(?iuU)\b({pattern})\b"))


def is_own_language(text: Column, least: int = L.MIN_LANGUAGE, ratio: float = L.LANGUAGE_RATIO, foreign: str | None = None, own: str = L.OWN_WORDS) -> Column:
    """Short text stays; longer text goes if foreign function words outweigh the own ones."""
    foreign = foreign or "|".join(L.FOREIGN_WORDS)
    return (F.char_length(text) < least) | ~(language_hits(text, foreign) > F.lit(ratio) * language_hits(text, own))


def recurrent_lines(lines: DataFrame, key: str, repeats: int = L.PAGE_REPEATS, longest: int = L.MAX_RECURRENT) -> DataFrame:
    """Adds keep: lines of a document that occur fewer than `repeats` times, or are longer than `longest`."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key, "text"))
    return lines.withColumn("keep", (n < repeats) | (F.char_length("text") > longest))


def tokens(text: Column) -> Column:
    """Tokens of two or more word characters, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), 0)


def terms(text: Column, most: int = 3) -> Column:
    """Tokens and their n-grams, shorter ones first, with repetition."""

    def grams(words: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
        return F.when(F.size(words) >= n, F.transform(places, lambda i: F.concat_ws(" ", *[F.get(words, i - 1 + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))

    # bound to a lambda's variable, the tokens are found once and not again for every n-gram
    return F.transform(F.array(tokens(text)), lambda words: F.concat(words, *[grams(words, n) for n in range(2, most + 1)]))[0]


def counted(words: Column) -> Column:
    """Distinct words of an array with their counts, as structs (term, n): sorted once, then cut where the word changes."""

    def cut(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        ends = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: (last >= 0) & ((i == last) | (F.get(ordered, i) != F.get(ordered, i + 1))))
        return F.transform(F.array(ends), lambda e: F.transform(e, lambda i, k: F.struct(F.get(ordered, i).alias("term"), (i - F.coalesce(F.get(e, k - 1), F.lit(-1))).cast("long").alias("n"))))[0]

    return F.transform(F.array(F.sort_array(words)), cut)[0]


def mask_email(col: Column) -> Column:
    """Two characters of the user, then ***@ and the domain."""
    return F.regexp_replace(col, r"^(.{0,2})[^@]*@(.*)$", "$1***@$2")


def match_with_context(text: Column, pattern: str, width: int = 120) -> Column:
    """First match, its place (0-based, -1 if none) and the text around it."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.struct(
        F.regexp_extract(text, pattern, 0).alias("match"), (at - 1).alias("position"),
        F.when(at > 0, F.substring(text, F.greatest(at - width, F.lit(1)), at - F.greatest(at - width, F.lit(1)) + F.char_length(F.regexp_extract(text, pattern, 0)) + width)).otherwise("").alias("snippet"),
    )


def safe_decode(body: Column, limit: int = 5_000_000) -> Column:
    """UTF-8 if it is valid, else Latin-1, of the first `limit` bytes."""
    part = F.substring(body, 1, limit)
    return F.when(F.call_function("is_valid_utf8", part), F.decode(part, "UTF-8")).otherwise(F.decode(part, "ISO-8859-1"))


def citation_parts(text: Column, size: int = 50) -> list[Column]:
    """Start, middle and end fragments of a citation."""
    n = F.char_length(text)
    return [F.substring(text, F.lit(1), F.lit(size)), F.substring(text, F.greatest(F.floor(n / 2).cast("int") - size // 2 + 1, F.lit(1)), F.lit(size)), F.substring(text, F.greatest(n - size + 1, F.lit(1)), F.lit(size))]


def locate_excerpt(document: Column, excerpt: Column) -> Column:
    """Place (0-based) of an excerpt: whole, else its first 120, 80 or 50 characters; -1 if none is found."""
    found = [F.nullif(F.call_function("instr", document, x), F.lit(0)) for x in [excerpt, *(F.substring(excerpt, F.lit(1), F.lit(n)) for n in (120, 80, 50))]]
    return F.coalesce(*found, F.lit(0)) - 1


def redact(text: Column) -> Column:
    return replace_all(text, (L.PERSONAL_DATA["correio"], "[correio]"), (L.PERSONAL_DATA["telefone"], "[telefone]"))
