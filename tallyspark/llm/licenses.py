"""License scan: normalised passages against licence templates by the Dice coefficient over word bigrams.

A text is cut into its lines, its sentences and its paragraphs; each is lower-cased and reduced to words. A passage
with a set of a bigrams can only reach a coefficient t with a template of b bigrams if 2 min(a, b) >= t (a + b), so
templates outside those bounds are pruned before any comparison, and passages outside the bounds of all templates
are dropped. That is DataFrame code; the templates are a few literals.

A notice may also be wrapped over lines, or be several sentences or paragraphs. So all runs of consecutive pieces
(cut at newlines and after sentences) are compared too, as long as the size bounds allow. Before either, one pass of an
automaton over the normalised text counts each template's bigrams; a text with fewer of every template than a passage
near it must share holds no such passage and goes no further.

Defined results: null and empty texts, and texts whose passages reach no template, have license null, dice 0 and no
passages; ties between templates go to the smaller name; a passage that occurs as line and sentence counts once;
a run of pieces counts as one more passage if it overlaps none that counts already, the best runs first;
repeated rows are scanned one by one; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

LEAST_DICE = 0.8
REPEATS = 2
WORDS = re.compile("[a-z0-9]+").findall
#: Name and public wording of notices.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit-permission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
]


def template_bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def word_bigrams(passage: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(passage), "[^a-z0-9]+", " ")), " ")
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


@functools.lru_cache(maxsize=4)
def bigram_automaton(grams: tuple[str, ...]):
    """Finds all template bigrams of a normalised text in one pass, however many templates there are."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for g in grams:
        out.add_word(f" {g} ", g)
    out.make_automaton()
    return out


def may_hold(text: str, sets: list[tuple[str, list[str]]], least: float) -> bool:
    """Whether the whole text has as many of some template's bigrams as a passage near it must share; loses no passage."""
    grams = tuple(sorted({g for _, s in sets for g in s}))
    normal = f" {' '.join(WORDS(text.lower()))} "
    found = {g for _, g in bigram_automaton(grams).iter(normal)}
    return any(sum(g in found for g in s) >= least * len(s) / (2 - least) - 1e-9 for _, s in sets) if found else False


def runs_of_pieces(text: str, sets: list[tuple[str, list[str]]], least: float) -> tuple[str, float, int, int] | None:
    """(license, dice, place, runs) for the runs of consecutive pieces that reach a template; sets in the order of names.

    A run has at most REPEATS times as many words as distinct bigrams that a template allows, or is one piece: however often a text
    repeats itself, the work grows with its length.
    """
    sizes = [len(g) for _, g in sets]
    high = max(sizes) * (2 - least) / least
    where: dict[str, list[int]] = {}
    for k, (_, grams) in enumerate(sets):
        for g in grams:
            where.setdefault(g, []).append(k)

    def pieces(pattern: str) -> list[tuple[int, int]]:
        cuts = [(m.start(), m.end()) for m in re.finditer(pattern, text)]
        return list(zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(text)], strict=True))

    units = [(a, b, w) for a, b in pieces(r"(?<=[.!?])[ \t\r\n]+|\n") if (w := re.findall("[a-z0-9]+", text[a:b].lower()))]
    follow = [*(u[2][0] for u in units[1:]), ""]
    held = [{g for g in map(" ".join, zip(w, [*w[1:], x])) if g in where} for (_, _, w), x in zip(units, follow, strict=True)]
    every = set().union(*held)
    if not any(len(every.intersection(g)) >= least * len(g) / (2 - least) - 1e-9 for _, g in sets):
        return None
    starts, ends = [a for a, _, _ in units], [b for _, b, _ in units]
    cuts = {(bisect_left(ends, a + 1), bisect_right(starts, b - 1) - 1) for p in (r"\n", r"\n[ \t\r]*\n") for a, b in pieces(p)} | {(k, k) for k in range(len(units))}
    numbers: dict[tuple, int] = {}
    content = [numbers.setdefault(tuple(w), len(numbers)) for _, _, w in units]
    many = [len(w) for _, _, w in units]

    def reached(i: int, stop: int) -> list[tuple[float, int, int]]:
        """(dice, place, pieces) of the runs from piece i on that reach a template and end before `stop`."""
        seen: set[str] = set()
        shared, last, out = [0] * len(sets), None, []
        for j in range(i, stop):
            for w in units[j][2]:
                gram = f"{last} {w}"
                if last is not None and gram not in seen:
                    seen.add(gram)
                    for k in where.get(gram, ()):
                        shared[k] += 1
                    if len(seen) > high:
                        return out
                last = w
            best = max((2.0 * n / (len(seen) + size), -k) for k, (n, size) in enumerate(zip(shared, sizes, strict=True)))
            if best[0] >= least:
                out.append((*best, j - i))
        return out

    found, known, stop, ahead = [], {}, 0, 0
    for i, (_, _, words) in enumerate(units):
        if stop <= i:
            stop, ahead = i, 0
        while stop < len(units) and (stop == i or ahead + many[stop] <= REPEATS * high):
            ahead += many[stop]
            stop += 1
        ahead -= many[i]  # the words of the pieces behind this one
        if not held[i] or (i + 2 < len(units) and words == units[i + 1][2] == units[i + 2][2]):
            continue  # the run that begins with the next piece is as good or better
        key = tuple(content[i:stop])
        if key not in known:
            known[key] = reached(i, stop)
        found += [(dice, place, i, i + n) for dice, place, n in known[key] if ends[i + n] - starts[i] >= 8]
    if not found:
        return None
    taken = [False] * len(units)
    for _, _, i, j in found:
        if (i, j) in cuts:
            taken[i : j + 1] = [True] * (j + 1 - i)
    runs = 0
    for _, _, i, j in sorted(found, key=lambda f: (-f[0], -f[1], f[3] - f[2], f[2])):
        if not any(taken[i : j + 1]):
            taken[i : j + 1] = [True] * (j + 1 - i)
            runs += 1
    dice, place = max(f[:2] for f in found)
    return sets[-place][0], dice, place, runs


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, least: float = LEAST_DICE) -> DataFrame:
    """Rows (id_col, license, dice, n_passages)."""
    sets = [(name, template_bigrams(text)) for name, text in templates]
    sizes = [len(s) for _, s in sets]
    low, high = least * min(sizes) / (2 - least), max(sizes) * (2 - least) / least
    text = F.coalesce(F.col("text"), F.lit(""))
    passages = F.array_distinct(F.concat(F.split(text, "\n"), F.split(F.regexp_replace(text, r"([.!?])[ \t\r\n]+", "$1\n"), "\n"), F.split(text, r"\n[ \t\r]*\n")))

    def dice(bigrams: Column) -> Column:
        size = F.size(bigrams)
        tried = [
            F.when((2 * F.least(size, F.lit(len(s))) >= least * (size + len(s))), F.struct((2.0 * F.size(F.array_intersect(bigrams, F.array(*map(F.lit, s)))) / (size + len(s))).alias("dice"), F.lit(-k).alias("place"), F.lit(name).alias("license")))
            for k, (name, s) in enumerate(sorted(sets))
        ]
        return F.array_max(F.filter(F.array(*tried), lambda t: t.isNotNull() & (t["dice"] >= least)))

    # One row a passage; few have a size that any template allows and share its words.
    ordered = sorted(sets)

    @F.pandas_udf("may boolean, dice double, place int, license string, runs long")
    def of_runs(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            may = isinstance(t, str) and may_hold(t, ordered, least)
            f = runs_of_pieces(t, ordered, least) if may else None
            rows.append((may, f[1], f[2], f[0], f[3]) if f else (may, None, None, None, 0))
        return pd.DataFrame(rows, columns=["may", "dice", "place", "license", "runs"]).astype({"may": bool, "dice": "float64", "place": "Int32", "license": object, "runs": "int64"})

    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("run", of_runs("text"))
    cut = cut.withColumn("passages", F.when(F.col("run.may"), F.filter(passages, lambda p: F.length(p) >= 8)).otherwise(F.array().cast("array<string>")))
    vocabulary = F.array(*[F.lit(w) for w in sorted({b for _, s in sets for b in s})])
    some = F.filter(F.transform("passages", word_bigrams), lambda b: F.size(b).between(low, high))
    scored = F.filter(F.transform(F.filter(some, lambda b: F.arrays_overlap(b, vocabulary)), dice), lambda d: d.isNotNull())
    out = cut.select("id", scored.alias("found"), "run")
    best = F.array_max(F.array_compact(F.array(F.array_max("found"), F.when(F.col("run.license").isNotNull(), F.struct("run.dice", "run.place", "run.license")))))
    out = out.select("id", best.alias("best"), (F.size("found") + F.col("run.runs")).cast("long").alias("n_passages"))
    return out.select(F.col("id").alias(id_col), F.col("best.license").alias("license"), F.coalesce("best.dice", F.lit(0.0)).alias("dice"), "n_passages")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


_ROWS = ", ".join("('{}', {}, [{}])".format(n, k, ", ".join(f"'{b}'" for b in template_bigrams(t))) for k, (n, t) in enumerate(sorted(TEMPLATES)))
ORACLE = rf"""
WITH templates(license, place, grams) AS (VALUES {_ROWS}),
d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT rn, unnest(list_distinct(list_concat(string_split(text, chr(10)), string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(10), 'g'), chr(10)), regexp_split_to_array(text, '\n[ \t\r]*\n')))) AS passage FROM d),
w AS (SELECT rn, passage, string_split(trim(regexp_replace(lower(passage), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM p WHERE length(passage) >= 8),
g AS (SELECT rn, passage, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w),
s AS (SELECT rn, passage, license, place, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM g, templates WHERE len(g) > 0),
b AS (SELECT rn, passage, max(struct_pack(dice := dice, place := -place, license := license)) AS b FROM s WHERE dice >= {LEAST_DICE} GROUP BY rn, passage),
r AS (SELECT rn, max(b) AS b, count(*) AS n FROM b GROUP BY rn)
SELECT doc_id, b.license AS license, coalesce(b.dice, 0.0)::DOUBLE AS dice, coalesce(n, 0)::BIGINT AS n_passages FROM d LEFT JOIN r USING (rn)
"""

QUERIES = {"op3_license_scan": op3_license_scan}
SQL = {"op3_license_scan": ORACLE}
