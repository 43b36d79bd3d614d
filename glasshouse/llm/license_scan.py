"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

Files are (path, text).  Headers are the lines of a file and, over lines joined, all runs of as many words as a statement has, so that
wrapped statements and those inside a paragraph count.  Inverse document frequencies of the statements' terms are counted over all files; a term of a
file that no statement has counts as one seen in no file.  A run or line is compared only if it has one of a few rare terms of a statement: the rest
of the statement's terms together are lighter than the threshold, so none that reaches it is missed.
A licence file (LICENSE, COPYING and the like) is first compared as a whole to the licences' full texts, whose frequencies are counted over these texts;
it has that licence at the threshold (as line 0), else that of its best header.
The best line or run of a file is its header licence (ties: the earlier template, then the earlier line).  A directory's licence is
that of its licence file if it has one, else of its best-scored file (ties: the smallest path).  A file
without a licence of its own inherits from the nearest directory above it that has one.  Inheritance
joins distinct directories, not files, to the directories above them.

Long texts are compared whole.  Nulls: a null text is empty; a null path has no directory and inherits nothing.  Repeated rows get equal values.
Empty table: empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasshouse.llm.common import steps, strings, written

THRESHOLD = 0.8
#: Common licence statements (public, from the licences' own "how to apply" sections).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
]
#: And the tag that names a licence, for all of these and the licences of full texts.
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in sorted({n for n, _ in TEMPLATES} | {"BSD-2-Clause", "ISC", "MPL-1.1", "LGPL-2.0"})]
#: Licences without a full text at hand: the text of a sibling with its name replaced.
SIBLINGS = [
    ("AGPL-3.0", "GPL-3.0", r"(?i)gnu\s+general", "GNU Affero General"),
    ("CC-BY-4.0", "CC-BY-SA-4.0", r"(?i)-?sharealike|-SA\b", ""),
    ("CC-BY-NC-4.0", "CC-BY-SA-4.0", r"(?i)sharealike", "NonCommercial"),
]
_TERM = re.compile(r"[a-z]+|\d+(?:\.\d+)*")
_LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)(\.[a-z]+)?$"


def terms(text: str) -> list[str]:
    """Words and numbers, and neighbouring pairs of them."""
    one = _TERM.findall(text.lower())
    return one + [f"{a} {b}" for a, b in zip(one[:-1], one[1:], strict=True)]


def full_texts() -> list[tuple[str, str]]:
    """The licences' full texts by name."""
    known = {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "licences").iterdir())}
    return [*known.items(), *((name, re.sub(old, new, known[of])) for name, of, old, new in SIBLINGS)]


class Scorer:
    def __init__(self, templates: list[tuple[str, str]], frequency: dict[str, int], files: int, threshold: float):
        self.names, self.threshold = [n for n, _ in templates], threshold
        self.idf = {t: math.log((1 + files) / (1 + frequency.get(t, 0))) + 1 for _, text in templates for t in terms(text)}
        self.unseen = math.log(1 + files) + 1
        self.vectors = [self.unit(Counter(terms(text))) for _, text in templates]
        self.lengths = [len(_TERM.findall(text.lower())) for _, text in templates]
        self.heavy: dict[str, list[int]] = {}  # and the templates that each is of
        for k, v in enumerate(self.vectors):
            rest = 1.0
            for t, w in sorted(v.items(), key=lambda x: (frequency.get(x[0], 0), -x[1], x[0])):  # any set whose rest is light enough will do: the rarest
                if rest < (0.99 * threshold) ** 2:
                    break
                self.heavy.setdefault(t, []).append(k)
                rest -= w * w
        # the words of each heavy term, the rarest first: a text without them cannot hold the term
        self.needs = sorted({tuple(sorted(set(t.split(" ")), key=lambda w: (frequency.get(w, 0), w))) for t in self.heavy})

    def unit(self, count: Counter) -> dict[str, float]:
        v = {t: n * self.idf.get(t, self.unseen) for t, n in count.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    def cosine(self, v: dict[str, float], k: int) -> float:
        return math.fsum(w * v[t] for t, w in self.vectors[k].items() if t in v)

    def line(self, text: str) -> tuple[float, int]:
        v = self.unit(Counter(terms(text)))
        return max((self.cosine(v, k), -k) for k in range(len(self.vectors)))

    def runs(self, text: str) -> Iterator[tuple[float, int, int]]:
        """Score, template and line of each run of a template's length that has a heavy term of it."""
        words, lines = [], []
        for i, line in enumerate(text.split("\n")):
            here = _TERM.findall(line.lower())
            words += here
            lines += [i] * len(here)
        starts: dict[int, set[int]] = {}
        for i, w in enumerate(words):
            for term, width in ((w, 1), (f"{w} {words[i + 1]}" if i + 1 < len(words) else "", 2)):
                for k in self.heavy.get(term, ()):
                    first, last = i + width - self.lengths[k], min(i, len(words) - self.lengths[k])
                    starts.setdefault(k, set()).update(range(max(0, first), max(0, last) + 1))
        known: dict[tuple, float] = {}
        for k, places in starts.items():
            for at in sorted(places):
                run = tuple(words[at : at + self.lengths[k]])
                score = known.get((k, run))
                if score is None:
                    score = known[k, run] = self.cosine(self.unit(Counter([*run, *map(" ".join, zip(run[:-1], run[1:], strict=True))])), k)
                yield score, k, lines[at]

    def best(self, text: str) -> tuple[str, float, int] | None:
        """Licence, score and line of the best line or run that reaches the threshold."""
        words = set(_TERM.findall(text.lower()))
        needs = [n for n in self.needs if words.issuperset(n)]
        if not needs:
            return None
        found = None
        for i, line in enumerate(text.split("\n")):
            low = line.lower()
            if any(all(w in low for w in n) for n in needs) and not self.heavy.keys().isdisjoint(terms(line)):
                score, k = self.line(line)
                if score >= self.threshold and (found is None or (round(score, 9), k, -i) > found):
                    found = round(score, 9), k, -i
        for score, k, i in self.runs(text):
            if score >= self.threshold and (found is None or (round(score, 9), -k, -i) > found):
                found = round(score, 9), -k, -i
        return None if found is None else (self.names[-found[1]], found[0], -found[2])


@lru_cache(maxsize=1)
def whole_scorer(texts: tuple[tuple[str, str], ...]) -> Scorer:
    return Scorer(list(texts), Counter(t for _, text in texts for t in set(terms(text))), len(texts), THRESHOLD)


def whole(text: str, texts: tuple[tuple[str, str], ...], threshold: float) -> tuple[str, float, int] | None:
    """Licence, score and line 0 of a licence file that is the full text of a licence."""
    score, k = whole_scorer(texts).line(text)
    return (texts[-k][0], round(score, 9), 0) if score >= threshold else None


def frequencies(files: DataFrame, templates: list[tuple[str, str]]) -> tuple[dict[str, int], int]:
    """In how many files each template term occurs, and the number of files: one row a term and task, then one a term."""
    wanted = {t for _, text in templates for t in terms(text)}
    single = {t for t in wanted if " " not in t}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for b in steps(batches, "text"):
            for text in strings(b.column("text")).to_pylist():
                count[""] += 1
                low = text.lower()
                here = single.intersection(_TERM.findall(low))
                count.update(here)
                if len(here) > 1:
                    pairs = {p for p in wanted - single if p.split(" ")[0] in here and p.split(" ")[1] in here}
                    if pairs:
                        count.update(pairs.intersection(terms(low)))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["term", "n"])

    found = {r.term: r.n for r in files.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found, found.get("", 0)


def headers(files: DataFrame, templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """path, id, license, score and line of every file; null where nothing reaches the threshold."""
    scorer, licence_file = Scorer(templates, *frequencies(files, templates), threshold), re.compile(_LICENCE_FILE)
    texts = tuple(full_texts())  # read on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, "text"):
            found = [
                (whole(t, texts, threshold) if p is not None and licence_file.search(p.rsplit("/", 1)[-1]) else None) or scorer.best(t)
                for t, p in zip(strings(b.column("text")).to_pylist(), b.column("path").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("path"), *(pa.array([f[i] if f else None for f in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.int32())))],
                names=["id", "path", "own", "score", "line"],
            )

    return files.select("id", "path", F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, path string, own string, score double, line int")


def scan(spark: SparkSession, files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files(id, path, text) to id, path, own, score, line, license, inherited_from and distance."""
    own = written(spark, headers(files, templates, threshold), "headers").withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withColumn("dir", F.when(F.col("path").contains("/"), F.col("dir")))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    licensed = own.where("own IS NOT NULL AND dir IS NOT NULL").groupBy("dir").agg(F.min(F.struct(~name.rlike(_LICENCE_FILE), -F.col("score"), F.col("path"), F.col("own"))).alias("best")).select(F.col("dir").alias("above"), F.col("best.own").alias("given"))
    dirs = own.where("dir IS NOT NULL").select("dir").distinct()
    ancestors = dirs.select("dir", F.posexplode(F.expr("transform(sequence(size(split(dir, '/')), 1, -1), n -> array_join(slice(split(dir, '/'), 1, n), '/'))")).alias("distance", "above"))
    nearest = ancestors.join(licensed, "above").groupBy("dir").agg(F.min(F.struct("distance", "above", "given")).alias("n")).select(F.col("dir").alias("from_dir"), "n")
    has = F.col("own").isNotNull()
    return own.join(nearest, F.col("dir") == F.col("from_dir"), "left").select(
        "id", "path", "own", "score", "line", F.coalesce("own", "n.given").alias("license"),
        F.when(~has, F.col("n.above")).alias("inherited_from"), F.when(~has, F.col("n.distance")).alias("distance"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: a directory for each source, below it one for each thousand identifiers, below it one for
    each hundred.  Identifiers that end in 00 lie in the first, those that end in 0 in the second, the others in the third."""
    n = F.col("doc_id").cast("long")
    thousand, hundred = F.floor(n / 1000).cast("string"), F.floor(n / 100).cast("string")
    places = F.when(n % 100 == 0, F.array()).when(n % 10 == 0, F.array(thousand)).otherwise(F.array(thousand, hundred))
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("-")), F.lit("/"), F.array_join(F.transform(places, lambda x: F.concat(x, F.lit("/"))), ""), n.cast("string"), F.lit(".txt"))
    return docs.select(n.alias("id"), path.alias("path"), "text")
