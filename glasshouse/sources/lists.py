"""Domain lists: ranked list, delimited list, union of sources."""

from __future__ import annotations

import csv
import gzip
import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from glasshouse.functions import lexicon as L
from glasshouse.functions.urls import has_suffix, host, with_public_suffix

# Column names that delimited lists use.
DOMAIN_COLUMNS = ["dominio", "domínio", "domain", "host", "hostname", "url", "site", "sitio", "endereco"]
STRATUM_COLUMNS = ["estrato", "stratum", "setor", "segmento", "categoria"]
RANK_COLUMNS = ["rank", "rank_tranco", "posicao"]


def check_params(list_id: str, top_n: int, suffixes: list[str]) -> None:
    """Fails early on a malformed selection."""
    if not list_id or not str(list_id).strip():
        raise ValueError("list_id is empty")
    if not 1 <= top_n <= 1_000_000:
        raise ValueError("top_n must be from 1 to 1000000")
    if bad := [s for s in suffixes if not s.startswith(".")]:
        raise ValueError(f"suffixes must start with a dot: {bad}")


def read_rank_lines(spark: SparkSession, path: str) -> DataFrame:
    """A headless list of rank, domain (gz or not); rows that do not parse become null and are dropped later."""
    return spark.read.schema("rank string, domain string").option("mode", "PERMISSIVE").csv(path)


CACHED = "list_id string, top_n int, content binary, sha256 string, byte_size long, received_bytes long, received_as_gzip boolean, cached_at timestamp"
GZIP_MAGIC = b"\x1f\x8b"  # fixed value: the first two bytes of a gzip file


def cache_list(spark: SparkSession, path: str, folder: str, list_id: str, top_n: int) -> DataFrame:
    """The cached list, always gzip, as one row with its provenance.  What is cached is never written again, and the source not read again."""
    check_params(list_id, top_n, [])
    place = f"{folder.rstrip('/')}/{list_id}_top{top_n}"
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):

        def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                zipped = [c[:2] == GZIP_MAGIC for c in part["content"]]
                part["received_bytes"], part["received_as_gzip"] = [len(c) for c in part["content"]], zipped
                part["content"] = [c if z else gzip.compress(c, mtime=0) for c, z in zip(part["content"], zipped, strict=True)]
                yield part

        files = spark.read.format("binaryFile").load(path).select("content").mapInPandas(packed, "content binary, received_bytes long, received_as_gzip boolean")
        files.select(
            F.lit(list_id).alias("list_id"), F.lit(top_n).alias("top_n"), "content", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("byte_size"), "received_bytes", "received_as_gzip",
            F.current_timestamp().alias("cached_at"),
        ).write.mode("overwrite").parquet(place)  # only what a broken run left is replaced
    return spark.read.schema(CACHED).parquet(place)


def cached_lines(cached: DataFrame) -> DataFrame:
    """rank, domain of a cached list; fails if the content no longer has its digest."""

    def unpacked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                yield pd.read_csv(io.BytesIO(gzip.decompress(content)), header=None, names=["rank", "domain"], usecols=[0, 1], dtype=str, keep_default_na=False, engine="c")

    sound = F.when(F.sha2("content", 256) == F.col("sha256"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("digest differs for list "), "list_id")).cast("boolean"))
    return cached.where(sound).select("content").mapInPandas(unpacked, "rank string, domain string")


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"  # fixed value: the namespace of workbooks
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def workbook_rows(data: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """The cells of a sheet (the first if none is named) of an xlsx file as text; gaps are null."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        sheets = {s.get("name"): s.get(_RELATION) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_SHEET}sheet")}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet} among {list(sheets)}")
        target = next(r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == sheets[sheet or next(iter(sheets))])
        tree = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    out = []
    for row in tree.iter(f"{_SHEET}row"):
        cells: dict[int, str | None] = {}
        for n, c in enumerate(row.iter(f"{_SHEET}c")):
            letters = re.match("[A-Z]*", c.get("r", "")).group()
            at = reduce(lambda a, x: a * 26 + ord(x) - 64, letters, 0) - 1 if letters else n
            value = c.findtext(f"{_SHEET}v")
            if c.get("t") == "s":
                value = shared[int(value)]
            elif c.get("t") == "inlineStr":
                value = "".join(t.text or "" for t in c.iter(f"{_SHEET}t"))
            cells[at] = value
        out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return out


def read_ratings(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A rater's returned sheet, all columns as text: an xlsx workbook, or text with ; or , whichever is more frequent."""
    first = spark.read.format("binaryFile").load(path).select("content").first()  # one small file
    data = bytes(first[0])
    if path.lower().endswith((".xlsx", ".xlsm")):
        rows = workbook_rows(data, sheet)
        names = [c or f"_{i}" for i, c in enumerate(rows[0])] if rows else []
        body = [tuple((r + [None] * len(names))[: len(names)]) for r in rows[1:]]
    else:
        text = data.decode("utf-8-sig")
        found = list(csv.reader(io.StringIO(text), delimiter=";" if text.count(";") >= text.count(",") else ","))
        names = found[0] if found else []
        body = [tuple((r + [None] * len(names))[: len(names)]) for r in found[1:] if r]
    return spark.createDataFrame(body, StructType([StructField(n, StringType()) for n in names]))


def ranked_domains(lines: DataFrame, suffixes: list[str] | None = None, top_n: int = 1_000_000, source: str = "tranco", listed: DataFrame | None = None) -> DataFrame:
    """lines(rank, domain) to url, tld, source_name, rank, stratum in order of rank."""
    domain = F.lower(F.trim("domain"))
    rows = lines.select(F.expr("try_cast(trim(rank) AS int)").alias("rank"), domain.alias("domain")).where(F.col("rank").between(1, top_n) & (F.col("domain") != ""))
    rows = rows.where(has_suffix(F.col("domain"), suffixes or []))
    if listed is None:
        listed = rows.sparkSession.createDataFrame([(s,) for s in L.PUBLIC_SUFFIXES], "suffix string")
    rows = with_public_suffix(rows, "domain", F.broadcast(listed))  # a suffix list is a parameter of bounded size
    return rows.select(F.concat(F.lit("https://"), "domain").alias("url"), "tld", F.lit(source).alias("source_name"), "rank", F.lit(None).cast("string").alias("stratum")).orderBy("rank")


def sniff(data: bytes) -> tuple[str, str, list[str]]:
    """Encoding, delimiter and header of a delimited file, from its first line."""
    for encoding in ("utf-8-sig", "cp1252", "latin-1"):
        try:
            text = data.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    line = text.splitlines()[0] if text.splitlines() else ""
    sep = max([";", ",", "\t"], key=line.count)
    return {"utf-8-sig": "UTF-8", "cp1252": "windows-1252", "latin-1": "ISO-8859-1"}[encoding], sep, [c.strip().strip('"').lstrip("﻿") for c in line.split(sep)]


def read_list(spark: SparkSession, path: str, sha256: str | None = None, domain_column: str | None = None, stratum_column: str | None = None) -> DataFrame:
    """A delimited list of hosts or URLs.  The file must have the given digest, if one is given, and a domain column."""
    first = spark.read.format("binaryFile").load(path).select("content").first()  # one small list file
    if first is None:
        raise FileNotFoundError(path)
    data = bytes(first[0])
    if sha256 and hashlib.sha256(data).hexdigest() != sha256.lower():
        raise ValueError(f"{path}: sha256 differs from the declared one")
    encoding, sep, header = sniff(data)
    low = {c.lower(): c for c in header}
    column = domain_column if domain_column in header else next((low[c] for c in DOMAIN_COLUMNS if c in low), None)
    if domain_column and domain_column not in header or column is None:
        raise ValueError(f"{path}: no domain column (coluna_dominio) among {header}")
    stratum = stratum_column or next((low[c] for c in STRATUM_COLUMNS if c in low), None)
    rows = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path).toDF(*header)
    rows = rows.withColumn("_seq", F.monotonically_increasing_id())
    return listed_hosts(rows, F.col(f"`{column}`"), F.col(f"`{stratum}`") if stratum else F.lit(None).cast("string"), F.col("_seq"))


def listed_hosts(rows: DataFrame, domain: Column, stratum: Column, order: Column, source: str = "csv") -> DataFrame:
    """Hosts without scheme and path, first occurrence of each, hosts without a dot dropped; in order."""
    named = rows.select(host(domain).alias("host"), stratum.alias("stratum"), order.alias("seq")).where(F.col("host").contains("."))
    first = named.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy("seq"))).where("n = 1")
    tld = F.concat(F.lit("."), F.element_at(F.split("host", r"\."), -1))
    return first.select(F.concat(F.lit("https://"), "host").alias("url"), tld.alias("tld"), F.lit(source).alias("source_name"), F.lit(None).cast("int").alias("rank"), "stratum", "seq")


def union_sources(parts: list[tuple[DataFrame, int | None]], override: DataFrame | None = None) -> DataFrame:
    """Explicit domains before sources; each source limited to its own maximum."""
    if override is not None:
        return override
    limited = [df.limit(n) if n else df for df, n in parts]
    out = limited[0]
    for df in limited[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def without_hosts(rows: DataFrame, host_column: str, parts: list[str] = L.EXCLUDED_HOST_PARTS, first_label: str = r"^(cdn|static|img|assets|api|mail|ns\d*|dns\d*)$") -> DataFrame:
    """Drops infrastructure hosts: by a part of the name or by the first label."""
    name = F.col(host_column)
    bad = F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(name, p)) | F.element_at(F.split(name, r"\."), 1).rlike(first_label)
    return rows.where(~bad)


def public_administration(name: Column) -> Column:
    return F.when(name.rlike(r"\.(gov|jus|mp|def|leg)\.br$"), "adm_publica").otherwise("outros")
