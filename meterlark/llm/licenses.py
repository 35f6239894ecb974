"""License scan: phrases, and an exact set-similarity join of text blocks with license templates
(DataFrame operations only).

Tokens are pairs of neighbouring words, so that word order counts. A text block meets a template if it
holds at least ``THRESHOLD`` of the template's distinct tokens and all tokens of its deciding words, which
tell it from its neighbours (``by nc``, ``version 3``). A template of n words is compared with blocks of
2 * step words every step words, step being the power of two from 2 * n on, so a copy of the template with
up to as many words again put into it stands whole in a block, however long the template is.

Tokens are ordered globally, the rarest in the corpus first; a meeting block must then hold one of the
template's first |T| - need + 1 tokens (prefix filter), must have ``need`` template tokens at all (length
filter), and its first common token must leave enough tokens behind it on both sides (positional
filter). What passes is verified by intersection, so no meeting block is lost and none is reported in
error.

Only tokens of the templates are ever counted, and the templates are a parameter of fixed size: the
token order (a row per template token) is the one thing that reaches the driver, and the template side
of the join is a literal table. Texts are read once; their phrases' places and tokens are stored, and all
that follows reads these. Texts are not shuffled.

Defined results: null and empty texts have no words, no labels and score 0; labels are distinct,
sorted and comma-joined (empty if none); the score is 1 with a base phrase, else the largest share
of a template found, else 0; repeated rows get equal results; an empty table gives an empty table;
extra columns are not read; templates of fewer than two words are refused.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.llm.common import ALNUM_BREAK, lower_ascii, materialise

#: Fixed values of the contract: phrase, label.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices and license texts in public use, as words: label, words that decide, text.
TEMPLATES = (
    ("mit", "mit license", "released under the mit license"),
    ("mit", "mit license", "licensed under the mit license"),
    ("mit", "", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2.0", "version 2 0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "license 2 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl-3.0", "license version 3", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "license version 2", "licensed under the gnu general public license version 2"),
    ("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "gnu lesser general", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2.0", "mozilla public license v 2 0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by", "attribution 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "attribution noncommercial 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "attribution sharealike 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
)

THRESHOLD, SHORTEST_STEP = 0.8, 16


def pairs_of(text: str) -> list[str]:
    """A template's distinct tokens, sorted."""
    words = text.split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def step_of(text: str) -> int:
    """Words between the starts of the blocks that a template is compared with."""
    return max(SHORTEST_STEP, 1 << (2 * len(text.split()) - 1).bit_length())


def needed(n: int, threshold: float) -> int:
    return math.ceil(threshold * n - 1e-9)


def _spaced(text: Column) -> Column:
    """The text's words joined by single blanks."""
    whole = F.coalesce(text, F.lit(""))
    # ``lower`` is much faster, and the same on a text of ASCII characters alone
    lowered = F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(lower_ascii(whole))
    return F.trim(F.regexp_replace(lowered, ALNUM_BREAK, " "))


def _places(t: Column, phrases: tuple) -> dict[str, Column]:
    """n_base, first_word, last_word and the array ``base`` of labels of a text ``t`` of ``_spaced``."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases:
        whole = rf"(?<![^ ]){phrase}(?![^ ])"
        n = F.regexp_count(t, F.lit(whole))
        found = F.contains(t, F.lit(phrase)) & (n > 0)
        before = lambda prefix: (F.length(prefix) - F.length(F.translate(prefix, " ", ""))).cast("long")
        counts.append(F.when(found, n).otherwise(0).cast("long"))
        firsts.append(F.when(found, before(F.substring(t, F.lit(1), F.regexp_instr(t, F.lit(whole)) - 1))))
        lasts.append(F.when(found, before(F.regexp_extract(t, f"(?s)^(.*){whole}", 1))))
        labels.append(F.when(found, F.lit(label)))
    return {
        "n_base": reduce(lambda a, b: a + b, counts),
        "first_word": F.least(*firsts),
        "last_word": F.greatest(*lasts),
        "base": F.array_sort(F.array_compact(F.array(*labels))),
    }


def _tokens(words: Column, wanted: list[str]) -> Column:
    """(p, t) of the pairs of neighbouring words that are ``wanted``, with p the first one's place.

    ``words`` has to be a stored column: an expression would be evaluated anew for every word.
    """
    firsts, seconds = (sorted({t.split()[k] for t in wanted}) for k in (0, 1))

    def pair(a: Column, p: Column) -> Column:
        b = F.get(words, p + 1)
        return F.when(a.isin(firsts) & b.isin(seconds), F.struct(p.alias("p"), F.concat(a, F.lit(" "), b).alias("t")))

    return F.filter(F.transform(words, pair), lambda x: x.isNotNull() & x["t"].isin(wanted))


def noted(docs: DataFrame, templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> DataFrame:
    """What is needed of each row of ``docs``, in one pass over the texts and stored without them.

    (doc_id, d, h, n_words, n_base, first_word, last_word, base, tokens), with ``d`` the id or a value for null, ``h``
    a hash of the text and ``tokens`` the places of the templates' tokens.
    """
    vocabulary = sorted({t for *_, text in templates for t in pairs_of(text)})
    spaced = docs.select("doc_id", F.xxhash64("text").alias("h"), _spaced(F.col("text")).alias("t"))
    words = spaced.withColumn("w", F.split("t", " "))
    rows = words.select(
        "doc_id",
        F.coalesce("doc_id", F.expr("-9223372036854775807L")).alias("d"),
        "h",
        F.when(F.col("t") == "", 0).otherwise(F.size("w")).cast("long").alias("n_words"),
        *[c.alias(name) for name, c in _places(F.col("t"), phrases).items()],
        _tokens(F.col("w"), vocabulary).alias("tokens"),
    )
    return materialise(rows, "noted")


def token_order(rows: DataFrame, templates: tuple = TEMPLATES) -> list[str]:
    """The templates' distinct tokens, the rarest in all ``rows`` of ``noted`` first."""
    vocabulary = sorted({t for *_, text in templates for t in pairs_of(text)})
    counts = {r["t"]: r["n"] for r in rows.select(F.explode("tokens.t").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def template_blocks(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(d, h, block, template, label, share) of every block of ``docs`` (doc_id, text) that meets a template."""
    _refuse(templates)
    return _blocks(noted(docs, templates), templates, threshold)


def _refuse(templates: tuple) -> None:
    if any(len(text.split()) < 2 for *_, text in templates):
        raise ValueError("a template needs two words or more")


def _blocks(noted_rows: DataFrame, templates: tuple, threshold: float) -> DataFrame:
    spark = noted_rows.sparkSession
    order = token_order(noted_rows, templates)
    rank = {t: k for k, t in enumerate(order)}
    sides, prefixes, held_by = [], [], set()
    for name, (label, decides, text) in enumerate(templates):
        own = sorted(rank[t] for t in pairs_of(text))
        need, step = needed(len(own), threshold), step_of(text)
        sides.append((name, label, own, sorted(rank[t] for t in pairs_of(decides)), need))
        prefixes += [(r, step, name, i) for i, r in enumerate(own[: len(own) - need + 1])]
        held_by |= {(order[r], r, step) for r in own}
    index = F.broadcast(spark.createDataFrame(prefixes, "token int, step int, template int, i int"))  # a row per prefix token
    side = F.broadcast(spark.createDataFrame(sides, "template int, label string, own array<int>, decides array<int>, need int"))
    steps = F.broadcast(spark.createDataFrame(sorted(held_by), "t string, token int, step int"))  # a row per template token
    firsts = sorted({order[r] for r, *_ in prefixes})
    rows = (
        noted_rows.filter(F.exists("tokens", lambda x: x["t"].isin(firsts)))
        .select("d", "h", F.inline("tokens"))
        .join(steps, "t")
    )
    # the blocks, of 2 * step words every step words, that hold both words of the pair
    last = F.expr("p div step")
    first = F.greatest(F.lit(0), last - F.when(F.col("p") % F.col("step") <= F.col("step") - 2, 1).otherwise(0))
    blocks = rows.select("d", "h", "step", "token", F.explode(F.sequence(first, last)).alias("block")).groupBy("d", "h", "step", "block")
    held = blocks.agg(F.array_sort(F.collect_set("token")).alias("held"))
    found = (
        held.select("d", "h", "step", "block", "held", F.posexplode("held").alias("j", "token"))
        .join(index, ["token", "step"])
        .groupBy("d", "h", "block", "held", "template")
        .agg(F.min(F.struct("i", "j")).alias("at"))
        .join(side, "template")
        .filter(F.size("held") >= F.col("need"))
        .filter(1 + F.least(F.size("own") - F.col("at.i") - 1, F.size("held") - F.col("at.j") - 1) >= F.col("need"))
    )
    return (
        found.withColumn("common", F.size(F.array_intersect("held", "own")))
        .filter((F.col("common") >= F.col("need")) & (F.size(F.array_except("decides", "held")) == 0))
        .select("d", "h", "block", "template", "label", (F.col("common") / F.size("own")).alias("share"))
    )


def scan(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The phrases' places, all labels and the score for each row of ``docs`` (doc_id, text)."""
    _refuse(templates)
    base = noted(docs, templates)
    found = _blocks(base, templates, threshold).groupBy("d", "h").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    none = F.array().cast("array<string>")
    return base.join(found, ["d", "h"], "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    listed = lambda tokens: f"[{', '.join(repr(t) for t in tokens)}]::VARCHAR[]"
    rows = ", ".join(
        f"('{label}', {step_of(text)}, {listed(pairs_of(text))}, {listed(pairs_of(decides))}, {needed(len(pairs_of(text)), THRESHOLD)})"
        for label, decides, text in TEMPLATES
    )
    places, bases = [], []
    for k, (phrase, label) in enumerate(PHRASES):
        words = phrase.split()
        same = " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(words, 1))
        places.append(f"list_filter(range(0, len(w) - {len(words) - 1}), lambda i: {same}) AS p{k}")
        bases.append(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(label, step, own, decides, need) AS (VALUES {rows}),
b AS (SELECT r, step, unnest(range(0, (len(w) + step - 1) // step)) AS b, w FROM d, (SELECT DISTINCT step FROM t)),
x AS (SELECT r, step, w[b * step + 1:b * step + 2 * step] AS w FROM b),
y AS (SELECT r, step, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS held FROM x),
c AS (SELECT r, label, decides, held, need, len(list_intersect(held, own)) AS n, len(own) AS m FROM y JOIN t USING (step)),
f AS (SELECT r, list(DISTINCT label) AS more, max(n / m::DOUBLE) AS share FROM c WHERE n >= need AND len(list_intersect(held, decides)) = len(decides) GROUP BY r),
p AS (SELECT r, doc_id, len(w) AS n_words, {', '.join(places)} FROM d),
q AS (SELECT *, list_concat(list_concat(p0, p1), p2) AS every, list_filter([{', '.join(bases)}], lambda x: x IS NOT NULL) AS base FROM p)
SELECT doc_id, n_words::BIGINT AS n_words, len(every)::BIGINT AS n_base, list_min(every)::BIGINT AS first_word,
    list_max(every)::BIGINT AS last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ','), '') AS labels,
    CASE WHEN len(every) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM q LEFT JOIN f USING (r)
"""


ORACLE_SQL = _sql()
