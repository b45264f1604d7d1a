"""License scans by a positional index of rare template words. DataFrame functions only."""

from __future__ import annotations

import math
import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import whole_text

#: Words of the contract, the base phrases and their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Notices as their licences publish them, with the phrases that no copy may lack.
NOTICES = {
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("except in compliance with the license", "governing permissions and limitations"),
    ),
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
        ("redistribution and use in source and binary forms", "must reproduce the above copyright notice"),
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        ("free software foundation", "at your option any later version"),
    ),
    "isc-notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee is hereby granted", "appear in all copies"),
    ),
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("deal in the software without restriction", "all copies or substantial portions of the software"),
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("mozilla public license v 2 0", "you can obtain one at"),
    ),
}

#: Short statements, whose every word must follow; they are templates that are their own key phrase.
STATEMENTS = {
    "apache-2.0": "apache license version 2 0", "cc-by-4.0": "cc by 4 0", "cc-by-nc-4.0": "cc by nc 4 0", "cc-by-sa-4.0": "cc by sa 4 0",
    "gpl-2.0": "gnu general public license version 2", "gpl-3.0": "gnu general public license version 3", "lgpl": "gnu lesser general public license", "mpl-2.0": "mozilla public license version 2 0",
}

#: Rare words by which a notice is found, how many of them must stand in their places, and by how many words those may drift.
ANCHORS, NEEDED, DRIFT = 6, 4, 8


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]


def words_of(text: str) -> tuple[str, ...]:
    """The words of a short text, as ``with_words`` has them."""
    lowered = "".join(LOWER[UPPER.index(c)] if c in UPPER else c for c in text)
    return tuple(re.findall(WORD, lowered))


def templates() -> tuple[list[Template], list[Template], list[Template]]:
    """Base phrases, short statements, and notices."""
    def exact(label: str, phrase: str) -> Template:
        return Template(label, words_of(phrase), (words_of(phrase),))

    notices = [Template(label, words_of(text), tuple(map(words_of, phrases))) for label, (text, phrases) in NOTICES.items()]
    return [exact(label, phrase) for phrase, label in BASE], [exact(*x) for x in STATEMENTS.items()], notices


def split_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with an empty one before or behind where it doesn't begin or end with a word; a text of
    single-byte characters takes the quicker way to the same."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.split(lowered, BETWEEN)


def with_words(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id and words of each row."""
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), split_words(whole_text(text_column)).alias("split"))
    lead, tail = (F.get("split", F.lit(0)) == "").cast("int"), (F.get("split", F.size("split") - 1) == "").cast("int")
    return rows.select("doc_id", F.slice("split", lead + 1, F.greatest(F.size("split") - lead - tail, F.lit(0))).alias("words"))


def rarity(rows: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """IDF of each template word over all rows: each counts its distinct template words, so a task sends a row a word."""
    total = rows.count()
    held = F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary)))
    counts = {r["word"]: r["count"] for r in rows.select(F.explode(held).alias("word")).groupBy("word").count().collect()}
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


# ---------------------------------------------------------------- places


def starts(word: str, offset: int) -> Column:
    """Where a template begins if this word of a row's postings is its word at ``offset``."""
    own = F.filter("postings", lambda p: p["word"] == word)
    return F.filter(F.transform(own, lambda p: p["at"] - offset), lambda s: s >= 0)


def ranked(words: tuple[str, ...], idf: dict[str, float]) -> list[tuple[str, int]]:
    """Words of a template that come once in it, rarest first, with their offsets; of a template that has none, its first word."""
    once = [(w, k) for k, w in enumerate(words) if words.count(w) == 1]
    return sorted(once or [(words[0], 0)], key=lambda x: (-idf[x[0]], x))


def looked_up(words: tuple[str, ...], idf: dict[str, float]) -> list[tuple[str, int]]:
    """The one or two rarest words of a phrase; a second one only where more than one other word would be left to verify."""
    return ranked(words, idf)[: 2 if len(words) > 2 else 1]


def places(words: tuple[str, ...], idf: dict[str, float]) -> Column:
    """All places where a phrase stands: the postings of its rarest words intersected by relative position, then all words verified."""
    first, *second = looked_up(words, idf)
    found = starts(*first)
    for other in second:
        found = F.array_intersect(found, starts(*other))
    known = {first, *second}

    def whole(s: Column) -> Column:
        checks = [F.get("words", s + k) == w for k, w in enumerate(words) if (w, k) not in known]
        out = F.lit(True)
        for c in checks:
            out = out & F.coalesce(c, F.lit(False))
        return out

    return F.filter(found, whole) if len(known) < len(words) else found


def rare(template: Template, idf: dict[str, float]) -> list[tuple[str, int]]:
    return ranked(template.words, idf)[:ANCHORS]


def span(template: Template) -> int:
    return len(template.words) + 2 * DRIFT


def bins(template: Template, idf: dict[str, float]) -> Column:
    """Where a notice may begin by each of its rare words, in bins of DRIFT words and the next ones, so that words may be added or lost;
    sorted, each bin as often as rare words agree on it."""
    def of(word: str, offset: int) -> Column:
        own = F.filter("postings", lambda p: p["word"] == word)

        def both(p: Column) -> Column:
            b = F.floor((p["at"] + (span(template) - offset)) / DRIFT).cast("int")
            return F.array(b, b + 1)

        return F.array_distinct(F.flatten(F.transform(own, both)))

    return F.array_sort(F.concat(*(of(*a) for a in rare(template, idf))))


def windows(at: Column, width: int) -> Column:
    """The windows of that width around places, counted like bins from a width before the text."""
    def around(p: Column) -> Column:
        w = F.floor((p + width) / width).cast("int")
        return F.array(w - 1, w, w + 1)

    return F.array_distinct(F.flatten(F.transform(at, around)))


def share(template: Template, idf: dict[str, float], held: str, near: str) -> Column:
    """The share of a notice's rare words that stand in their places, 0 unless enough do and all key phrases stand within about its length.

    In the sorted bins one that k rare words agree on comes k times. All steps are linear in the postings but for the sort.
    """
    anchors, out = len(rare(template, idf)), F.lit(0.0)
    for k in range(min(NEEDED, anchors), anchors + 1):
        def window(b: Column, i: Column) -> Column:
            return F.when(F.get(held, i + (k - 1)) == b, F.floor(b * DRIFT / span(template)).cast("int"))

        agreed = F.array_compact(F.transform(held, window))
        out = F.when(F.arrays_overlap(agreed, near), k / anchors).otherwise(out)
    return out


def scan_licenses(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and places of each row.

    The IDF of all template words is counted over all rows first. A row's postings are the words that the index looks up, the rarest of
    each template, with their positions; templates are found where postings agree on a beginning. Base phrases and short statements
    must then stand word by word; of notices, enough rare words and all key phrases. n_base counts the places of base phrases,
    first_word and last_word are the least and greatest of these (null without any), labels are distinct and sorted, places lists (label,
    word) of phrases and statements, and score is the largest share of a found template's rare words, 1 for phrases, 0 without a label. Null and
    empty texts have no words, null ids and repeated rows are rows like others, an empty table gives an empty one; other columns
    are not read. Nothing is shuffled but the counts of template words.
    """
    base, statements, notices = templates()
    phrases = [*base, *statements]
    rows = with_words(df, id_column, text_column)
    idf = rarity(rows, sorted({w for t in [*phrases, *notices] for w in t.words}))

    kept = {w for t in phrases for w, _ in looked_up(t.words, idf)} | {w for t in notices for p in t.phrases for w, _ in looked_up(p, idf)} | {w for t in notices for w, _ in rare(t, idf)}
    at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(sorted(kept)), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("at", at)
    rows = rows.select("doc_id", "words", F.transform("at", lambda i: F.struct(F.get("words", i).alias("word"), i.alias("at"))).alias("postings"))
    # Step by step, so that no expression is written out in several others.
    near = {k: [f"q{k}_{j}" for j in range(len(t.phrases))] for k, t in enumerate(notices)}
    rows = rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), *(places(t.words, idf).alias(f"p{k}") for k, t in enumerate(phrases)),
        *(windows(places(p, idf), span(t)).alias(near[k][j]) for k, t in enumerate(notices) for j, p in enumerate(t.phrases)), *(bins(t, idf).alias(f"b{k}") for k, t in enumerate(notices)),
    )
    rows = rows.select("doc_id", "n_words", *(f"p{k}" for k in range(len(phrases))), *(f"b{k}" for k in near), *(reduce(F.array_intersect, map(F.col, own)).alias(f"q{k}") for k, own in near.items()))
    found = rows.select("doc_id", "n_words", *(f"p{k}" for k in range(len(phrases))), *(share(t, idf, f"b{k}", f"q{k}").alias(f"s{k}") for k, t in enumerate(notices)))
    of_base = F.array_sort(F.concat(*(f"p{k}" for k in range(len(base)))))

    def placed(k: int, label: str) -> Column:
        return F.transform(f"p{k}", lambda p: F.struct(F.lit(label).alias("label"), p.cast("long").alias("word")))

    at_phrases = F.concat(*(placed(k, t.label) for k, t in enumerate(phrases)))

    def labels(*present: tuple[str, Column]) -> Column:
        named = F.array(*(F.when(there, label) for label, there in present))
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(named))), ",")

    by_phrase = [(t.label, F.size(f"p{k}") > 0) for k, t in enumerate(phrases)]
    by_notice = [(t.label, F.col(f"s{k}") > 0) for k, t in enumerate(notices)]
    any_phrase = F.lit(False)
    for _, there in by_phrase:
        any_phrase = any_phrase | there
    return found.select(
        "doc_id", "n_words", F.size(of_base).cast("long").alias("n_base"), F.get(of_base, F.lit(0)).cast("long").alias("first_word"), F.get(of_base, F.size(of_base) - 1).cast("long").alias("last_word"),
        labels(*by_phrase[: len(base)]).alias("base_labels"), labels(*by_phrase, *by_notice).alias("labels"),
        F.greatest(F.when(any_phrase, 1.0).otherwise(0.0), *(f"s{k}" for k in range(len(notices)))).alias("score"), at_phrases.alias("places"),
    )


def op11_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("places")


def license_sql() -> str:
    """The statement that ``op11_license_scans`` equals: by joins of all words with the templates' words instead of an index."""
    base, statements, notices = templates()

    def listed(words: tuple[str, ...]) -> str:
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    phrases = [(t.label, int(k < len(base)), listed(t.words)) for k, t in enumerate([*base, *statements])]
    once = [(t.label, w, k, span(t)) for t in notices for k, w in enumerate(t.words) if t.words.count(w) == 1]
    keys = [(t.label, k, span(t), listed(p)) for t in notices for k, p in enumerate(t.phrases)]

    def values(rows: list[tuple]) -> str:
        return ", ".join("(" + ", ".join(x if isinstance(x, str) and x[:1] == "[" else repr(x) for x in r) + ")" for r in rows)

    return f"""
WITH phrase(label, base, words) AS (VALUES {values(phrases)}), once(label, word, place, span) AS (VALUES {values(once)}), mandatory(label, number, span, words) AS (VALUES {values(keys)}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
t AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS at_ FROM d),
f AS (SELECT word, count(DISTINCT r) AS n FROM t GROUP BY word),
rare AS (SELECT o.*, count(*) OVER (PARTITION BY o.label) AS many FROM (SELECT o.* FROM once o LEFT JOIN f ON f.word = o.word QUALIFY row_number() OVER (PARTITION BY o.label ORDER BY coalesce(f.n, 0), o.word, o.place) <= {ANCHORS}) o),
p AS (SELECT t.r, p.label, p.base, t.at_ FROM t JOIN phrase p ON t.word = p.words[1] JOIN d ON d.r = t.r WHERE d.words[t.at_ + 1:t.at_ + len(p.words)] = p.words),
k AS (SELECT t.r, m.label, m.number, unnest([w - 1, w, w + 1]) AS w FROM (SELECT t.r, m.label, m.number, (t.at_ + m.span) // m.span AS w FROM t JOIN mandatory m ON t.word = m.words[1] JOIN d ON d.r = t.r WHERE d.words[t.at_ + 1:t.at_ + len(m.words)] = m.words) t JOIN mandatory m USING (label, number)),
need AS (SELECT label, count(*) AS n FROM mandatory GROUP BY label),
near AS (SELECT k.r, k.label, k.w FROM k JOIN need ON need.label = k.label GROUP BY k.r, k.label, k.w, need.n HAVING count(DISTINCT k.number) = need.n),
b AS (SELECT r, label, span, many, b, count(DISTINCT word) AS n FROM (SELECT t.r, a.label, a.span, a.many, a.word, unnest([x, x + 1]) AS b FROM (SELECT t.r, a.*, CAST(floor((t.at_ - a.place + a.span) / {DRIFT}) AS BIGINT) AS x FROM t JOIN rare a ON a.word = t.word) a JOIN t ON t.r = a.r AND t.at_ = 0) GROUP BY ALL),
s AS (SELECT b.r, b.label, max(b.n / b.many) AS share FROM b JOIN near ON near.r = b.r AND near.label = b.label AND near.w = CAST(floor(b.b * {DRIFT} / b.span) AS BIGINT) WHERE b.n >= least({NEEDED}, b.many) GROUP BY ALL),
l AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM p UNION SELECT r, label FROM s) GROUP BY r),
g AS (SELECT r, count(*) FILTER (base = 1) AS n, min(at_) FILTER (base = 1) AS low, max(at_) FILTER (base = 1) AS high, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base = 1) AS labels FROM p GROUP BY r)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_base, CAST(g.low AS BIGINT) AS first_word, CAST(g.high AS BIGINT) AS last_word, coalesce(g.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  CASE WHEN g.r IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce((SELECT max(share) FROM s WHERE s.r = d.r), 0) END AS score
FROM d LEFT JOIN g ON g.r = d.r LEFT JOIN l ON l.r = d.r"""
