"""License scan: exact phrases, and an exact set-similarity join with notice templates.

Text blocks are windows of the whole text's words, line ends or not: each has twice as
many words as the longest template, ``BLOCK`` at least, and they start at every half of
that, so any notice lies in one block. A template matches a block that holds at least
``THRESHOLD`` of its distinct words. A match counts unless another match of the block
holds all the words that it found, as "version 3" does for those of "version 2".

The join is exact and relational: template words on one side, block words on the other.
Template words are ordered by document frequency over the whole corpus, rarest first.
With ``need`` common words asked for, a match must share a word among the first
``|T| - need + 1`` of the template and the first ``|B| - need + 1`` of the block (prefix
filter), the block must have ``need`` template words (length filter), and what follows
the first shared word on either side must still suffice (positional filter). Survivors
are verified by a second join.

Texts are read once, for a table of counts, places and template words; only texts that
hold ``need`` words of a template at all go on to the join, with their words. Groups of
the join are blocks, so a long text is spread over tasks like many short ones. The
template words stand in the plan as one array, so their number is bounded by
``MAX_WORDS``.

Defined results
    null or empty text: no words, no places, labels '' and score 0;
    very long text: scanned whole; repeated rows: one result for each;
    equal matches of one block: the one with the better score, then with more words, then
    the smaller label; an empty table: no rows; further columns, whatever their names,
    are left out.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import TMP, ascii_lower, drop, materialize, string_array, text_of

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
THRESHOLD = 0.8
BLOCK = 64
MAX_WORDS = 5000

#: The sentences by which works state their license.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc0-1.0", "released under cc0 1 0 universal public domain dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
)


def template_sets(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(text.split()))) for label, text in templates]


def _need(n: int, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * n, 9)))


def half_block(templates=TEMPLATES) -> int:
    return max(BLOCK // 2, *[len(text.split()) for _, text in templates])


def _places(words: str, lower: str, phrase: str) -> Column:
    parts = phrase.split()
    gate = F.col(lower).rlike(SEPARATOR.join(parts))
    follows = lambda i: [F.get(F.col(words), i + F.lit(k)) == p for k, p in enumerate(parts) if k]
    hit = lambda w, i: F.when(reduce(lambda a, b: a & b, follows(i), w == parts[0]), i)
    return F.when(gate, F.array_compact(F.transform(words, hit))).otherwise(F.array().cast("array<int>"))


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATOR, -1), "")


def template_rows(seen: DataFrame, templates, threshold: float) -> DataFrame:
    """``t, label, n, need, w, place, rank`` of every template word: its place in the order of
    document frequencies in ``seen`` (w), rarest first, in the template and overall."""
    spark = seen.sparkSession
    sets = template_sets(templates)
    each = lambda i, label, ws: F.struct(F.lit(i).alias("t"), F.lit(label).alias("label"), F.lit(len(ws)).alias("n"), F.lit(_need(len(ws), threshold)).alias("need"), string_array(ws).alias("ws"))
    listed = spark.range(1).select(F.inline(F.array(*[each(i, *s) for i, s in enumerate(sets)]))).select("t", "label", "n", "need", F.explode("ws").alias("w"))
    counts = seen.groupBy("w").agg(F.count("*").alias("df"))
    ranked = listed.join(counts, "w", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    order = [F.col("df"), F.col("w")]
    # the template list is what is ranked, in one task; MAX_WORDS bounds it
    overall = ranked.select("w", "df").distinct().select("w", F.row_number().over(Window.orderBy(*order)).alias("rank"))
    place = F.row_number().over(Window.partitionBy("t").orderBy(*order))
    return ranked.select("t", "label", "n", "need", "w", place.alias("place")).join(overall, "w")


def block_matches(texts: DataFrame, template: DataFrame, half: int) -> DataFrame:
    """``rid, b, found``: the matches that count in each block of ``texts`` (rid, words), as
    structs (score, n, label, words)."""
    at, rest = F.floor(F.col("pos") / F.lit(half)), F.size("words")
    placed = texts.select("rid", F.posexplode("words").alias("pos", "w"), rest.alias("size"))
    placed = placed.join(template.select("w", "rank").distinct(), "w")
    # words of the last half are in one block only, if there is one before
    last = F.greatest(F.lit(0), F.floor((F.col("size") - F.lit(half + 1)) / F.lit(half)))
    blocks = placed.select("rid", "w", "rank", F.explode(F.array_distinct(F.array(F.least(at, last), F.greatest(F.lit(0), at - 1)))).alias("b")).distinct()
    block = Window.partitionBy("rid", "b")
    blocks = materialize(blocks.select("rid", "b", "w", F.row_number().over(block.orderBy("rank")).alias("place_b"), F.count("*").over(block).alias("size_b")), "blocks")
    shared = blocks.where("size_b > 0").join(template, "w").where("size_b >= need and place <= n - need + 1 and place_b <= size_b - need + 1")
    first = shared.groupBy("rid", "b", "t", "n", "need", "size_b").agg(F.min("place").alias("p"), F.min("place_b").alias("q"))
    candidates = first.where("least(n - p, size_b - q) + 1 >= need").select("rid", "b", "t")
    common = candidates.join(blocks.select("rid", "b", "w"), ["rid", "b"]).join(template.select("t", "w", "n", "need", "label"), ["t", "w"])
    match = common.groupBy("rid", "b", "t", "n", "need", "label").agg(F.sort_array(F.collect_list("w")).alias("words"))
    match = match.where(F.size("words") >= F.col("need")).select("rid", "b", F.struct((F.size("words") / F.col("n")).alias("score"), "n", "label", "words").alias("m"))
    per = match.groupBy("rid", "b").agg(F.collect_list("m").alias("all"))

    def beats(o: Column, m: Column) -> Column:
        better = F.when(o["score"] != m["score"], o["score"] > m["score"]).when(o["n"] != m["n"], o["n"] > m["n"]).otherwise(o["label"] < m["label"])
        return (F.size(F.array_except(m["words"], o["words"])) == 0) & ((F.size(o["words"]) > F.size(m["words"])) | better)

    return per.select("rid", "b", F.filter("all", lambda m: ~F.exists("all", lambda o: beats(o, m))).alias("found"))


def license_scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``keep``, word and phrase counts, labels and score of each text."""
    sets, half = template_sets(templates), half_block(templates)
    vocabulary = sorted({w for _, ws in sets for w in ws})
    if len(vocabulary) > MAX_WORDS:
        raise ValueError(f"templates of {len(vocabulary)} different words; {MAX_WORDS} at most")
    t, w, hits, seen, rid = (f"{TMP}{x}" for x in ("lower", "words", "hits", "seen", "rid"))
    df = docs.select(*keep, ascii_lower(text_of(text_col)).alias(t)).select(*keep, t, _split(F.col(t)).alias(w))
    df = df.withColumn(seen, F.array_intersect(w, string_array(vocabulary)))
    needs = [F.struct(string_array(ws).alias("ws"), F.lit(_need(len(ws), threshold)).alias("need")) for _, ws in sets]
    enough = F.exists(F.array(*needs), lambda x: F.size(F.array_intersect(x["ws"], F.col(seen))) >= x["need"])
    places = [(_places(w, t, phrase), label) for phrase, label in PHRASES]
    df = df.select(*keep, w, seen, *[p.alias(f"{hits}{i}") for i, (p, _) in enumerate(places)])
    lean = materialize(
        df.select(
            *keep,
            F.monotonically_increasing_id().alias(rid),
            F.size(w).cast("bigint").alias("n_words"),
            F.concat(*[F.col(f"{hits}{i}") for i in range(len(places))]).alias(hits),
            F.array_compact(F.array(*[F.when(F.size(f"{hits}{i}") > 0, label) for i, (_, label) in enumerate(places)])).alias(f"{TMP}base"),
            seen,
            F.when(enough, F.col(w)).alias(w),
        ),
        "scanned",
    )
    template = materialize(template_rows(lean.select(F.explode(seen).alias("w")), templates, threshold), "templates")
    matches = block_matches(lean.where(F.col(w).isNotNull()).select(F.col(rid).alias("rid"), F.col(w).alias("words")), template, half)
    found = matches.select("rid", F.explode("found").alias("m")).groupBy("rid").agg(F.collect_set("m.label").alias(f"{TMP}found"), F.max("m.score").alias(f"{TMP}score"))
    df = lean.join(found, F.col(rid) == F.col("rid"), "left")
    none = F.array().cast("array<string>")
    return df.select(
        *keep,
        "n_words",
        F.size(hits).cast("bigint").alias("n_base"),
        F.array_min(hits).cast("bigint").alias("first_word"),
        F.array_max(hits).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(f"{TMP}base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(f"{TMP}base", F.coalesce(f"{TMP}found", none)))), ",").alias("labels"),
        F.when(F.size(hits) > 0, 1.0).otherwise(F.coalesce(f"{TMP}score", F.lit(0.0))).alias("score"),
    )


def oracle(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The query in DuckDB SQL, every block against every template."""
    sep, half = SEPARATOR, half_block(templates)
    listed = ", ".join(f"({i}, '{label}', {len(s)}, {_need(len(s), threshold)}, {s!r})" for i, (label, s) in enumerate(template_sets(templates)))

    def places(phrase: str) -> str:
        tests = " and ".join(f"words[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split()))
        return f"list_filter(range(0, len(words)), lambda i: {tests})"

    base = " || ".join(f"case when len(h{i}) > 0 then ['{label}'] else [] end" for i, (_, label) in enumerate(PHRASES))
    return rf"""
with docs as (
  select row_number() over () as r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
), w as (
  select r, doc_id, t, list_filter(string_split_regex(t, '{sep}'), lambda x: x <> '') as words from docs
), h as (
  select r, doc_id, len(words) as n, {", ".join(f"{places(p)} as h{i}" for i, (p, _) in enumerate(PHRASES))} from w
), b as (
  select r, doc_id, n, h0 || h1 || h2 as hits, {base} as base from h
), tpl(k, label, size, need, tokens) as (
  values {listed}
), blocks as (
  select r, s, list_distinct(words[s + 1 : s + {2 * half}]) as block
  from (select r, words, unnest(range(0, greatest(0, floor((len(words) - {half + 1}) / {half})::bigint * {half}) + 1, {half})) as s from w)
), found as (
  select r, s, k, label, size, list_intersect(tokens, block) as common, need from blocks, tpl
), good as (
  select *, len(common) / size as score from found where len(common) >= need
), kept as (
  select * from good m where not exists (
    select 1 from good o where o.r = m.r and o.s = m.s and list_has_all(o.common, m.common) and (len(o.common) > len(m.common)
      or case when o.score <> m.score then o.score > m.score when o.size <> m.size then o.size > m.size else o.label < m.label end))
), per as (
  select r, list(label) as found, max(score) as score from kept group by r
)
select doc_id, n::bigint as n_words, len(hits)::bigint as n_base, list_min(hits)::bigint as first_word, list_max(hits)::bigint as last_word,
  array_to_string(list_sort(base), ',') as base_labels,
  array_to_string(list_sort(list_distinct(base || coalesce(found, []))), ',') as labels,
  case when len(hits) > 0 then 1.0::double else coalesce(score, 0)::double end as score
from b left join per using (r)
"""
