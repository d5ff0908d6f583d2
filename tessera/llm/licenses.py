"""Find license notices: MinHash bands over overlapping windows, then exact containment.

Texts and templates are words (runs of letters and digits, lower case) and their
five-word shingles. A template of m shingles is sought in windows of 2m - 1
shingles, every m: so each place where it can stand lies wholly in a window. A
window that holds the share CONTAINED of it has a Jaccard similarity of at least
need / (2m - 1 + m - need); as many bands of one MinHash value are used as make a
collision likelier than 1 - MISS at that similarity. Windows that share a band with
a template are verified exactly.

A notice contains one of a few words of each template (its anchors: every set of
shingles that is large enough to match has one), so texts without any anchor are
dropped before they are cut into words; that loses nothing.

Only DataFrame functions are used. Templates are a parameter; each MOST_TEMPLATES of
them are sought in one scan, so the broadcast of their bands is bounded and no number
of templates is refused.

Null ids take no part; null and empty texts match nothing; rows that repeat count
once. Templates of fewer than five words are refused. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, CONTAINED, MISS, MOST_TEMPLATES = 5, 0.8, 1e-4, 2000

#: Notices and whole texts as their licenses give them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "BSD grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
}


def plain_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once: an expression named inside a lambda would run for every element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _shingles(words: Column) -> Column:
    """Hashes of all runs of five words; an empty array if there are fewer."""

    def of(w: Column) -> Column:
        run = lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, SHINGLE)))
        return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0))), run)

    return _let(words, of)


def _bands(shingles: Column, n: int, m: int) -> Column:
    """One band for each of n MinHash values, of windows for templates of m shingles."""

    def least(j: int) -> Column:
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(j))))

    return F.array(*[F.xxhash64(F.lit(j), F.lit(m), least(j)) for j in range(n)])


def _windows(shingles: str, m: int) -> Column:
    """Slices of 2m - 1 shingles, one at every m-th."""

    def of(s: Column) -> Column:
        starts = F.sequence(F.lit(0), ((F.size(s) - 1) / m).cast("int"))
        return F.transform(starts, lambda k: F.slice(s, k * m + 1, F.lit(2 * m - 1)))

    return _let(F.col(shingles), of)


def _placed(windows: Column, m: int) -> Column:
    """Windows with the size of their templates and the places where they begin."""
    return F.transform(windows, lambda x, k: F.struct(F.lit(m).alias("m"), (k * m).cast("int").alias("at"), x.alias("x")))


def anchors(templates: dict[str, str]) -> list[str]:
    """Words, the longest first, without which a template's shingles are too few to match."""
    out: list[str] = []
    for text in templates.values():
        words = plain_words(text)
        runs = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        if not runs:
            raise ValueError(f"a template needs {SHINGLE} words: {text}")
        enough = len(runs) - math.ceil(CONTAINED * len(runs) - 1e-9) + 1
        chosen = [w for w in out if any(w in r for r in runs)]
        hit = lambda chosen: sum(any(w in r for w in chosen) for r in runs)
        for w in sorted(set(words), key=lambda w: (-len(w), w)):
            if hit(chosen) >= enough:
                break
            chosen.append(w)
            out.append(w)
    return sorted(set(out))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment, word: the best place of each notice in each document."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    schema = "doc_id long, license string, containment double, word int"
    if len(templates) > MOST_TEMPLATES:
        names = sorted(templates)
        parts = [scan(docs, {n: templates[n] for n in names[at : at + MOST_TEMPLATES]}) for at in range(0, len(names), MOST_TEMPLATES)]
        return reduce(DataFrame.unionByName, parts)
    by_size: dict[int, list[tuple[str, list[str]]]] = {}
    for name, text in templates.items():
        words = plain_words(text)
        by_size.setdefault(len(words) - SHINGLE + 1, []).append((name, words))
    lower = F.lower("text")
    some = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), lower.alias("text"))
    words_of = anchors(templates)
    hit = F.lit(False)
    for w in words_of:
        hit = hit | F.contains("text", F.lit(w))
    some = some.where(hit).select("doc_id", F.regexp_extract_all("text", F.lit("([\\p{L}\\p{N}]+)"), F.lit(1)).alias("w"))
    some = some.select("doc_id", _shingles(F.col("w")).alias("s")).where("size(s) > 0")
    if not by_size:
        return spark.createDataFrame([], schema)
    cut, banded, wanted = [], None, None
    for m, own in sorted(by_size.items()):
        known = spark.createDataFrame(own, "license string, w array<string>").select("license", F.array_distinct(_shingles(F.col("w"))).alias("t"))
        fewest = min(len({tuple(w[i : i + SHINGLE]) for i in range(m)}) for _, w in own)
        need = math.ceil(CONTAINED * fewest - 1e-9)
        least = need / (2 * m - 1 + fewest - need)
        n = 1 if least >= 1 else math.ceil(math.log(MISS) / math.log(1 - least))
        cut.append(_placed(_windows("s", m), m))
        own_bands = _bands(F.col("w.x"), n, m)
        banded = F.when(F.col("w.m") == m, own_bands) if banded is None else banded.when(F.col("w.m") == m, own_bands)
        rows = known.select("license", "t", F.explode(_bands(F.col("t"), n, m)).alias("band"))
        wanted = rows if wanted is None else wanted.unionByName(rows)
    # One scan: each text is cut into the windows of all template sizes at once, and these meet all templates in one join.
    windows = some.select("doc_id", F.explode(F.concat(*cut)).alias("w"))
    pairs = windows.select("doc_id", "w.at", "w.x", F.explode(banded).alias("band")).join(F.broadcast(wanted), "band")
    share = F.size(F.array_intersect("x", "t")) / F.size("t")
    place = F.array_min(F.filter(F.transform("x", lambda x, i: F.when(F.array_contains(F.col("t"), x), i)), lambda i: i.isNotNull()))
    every = pairs.withColumn("share", share).where(F.col("share") >= CONTAINED).select("doc_id", "license", "share", (F.col("at") + place).cast("int").alias("word"))
    # The best place, the first of them.
    best = every.groupBy("doc_id", "license").agg(F.min(F.struct((-F.col("share")).alias("share"), "word")).alias("b"))
    return best.select("doc_id", "license", (-F.col("b.share")).alias("containment"), F.col("b.word").alias("word"))
