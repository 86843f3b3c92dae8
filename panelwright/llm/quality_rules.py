"""Quality rules: a threshold table compiled into one Spark projection.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Every measure is a Spark expression on the
row's own text, so there is no shuffle, no join and no Python; a source that holds a
third of all rows makes no difference.

Defined results
    null or empty text: no words, all counts 0, ``base_failed``, not kept;
    very long text: measured whole; repeated rows: one result for each;
    an empty table: no rows; further columns of the input are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import TMP, text_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Very common words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by at or from this an have not "
    "le la les de des du et en un une est que qui dans pour par sur au avec ne se il "
    "der die das und den von zu mit ist im dem nicht ein eine für auf als auch sich es "
    "el los las del y que por con una para se su al lo como más no sus"
).split()

#: name, numerator, denominator, least and greatest ratio allowed (None: open). A ratio
#: with a denominator of 0 passes.
THRESHOLDS = (
    ("word_length", "word_chars", "n_words", 1.5, 15.0),
    ("symbols", "n_symbols", "n_words", None, 0.5),
    ("stop_words", "n_stop_words", "n_words", 0.02, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    ("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    ("shouted_words", "n_shouted", "n_words", None, 0.5),
)


def _rule(numerator: str, denominator: str, low: float | None, high: float | None) -> Column:
    ratio = F.col(numerator) / F.nullif(F.col(denominator), F.lit(0))
    tests = [ratio >= low] if low is not None else []
    tests += [ratio <= high] if high is not None else []
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(True))


def compile_rules(thresholds=THRESHOLDS) -> Column:
    """One boolean expression over the measures: does the row pass every rule?"""
    return reduce(lambda a, b: a & b, [_rule(*rule[1:]) for rule in thresholds])


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the measures of each text.

    ``n_repeat_words`` hashes each word and each window of eight word hashes to 64 bits.
    Only rows with a hash seen twice sort their windows; the words that repeated windows
    cover then follow from the gaps between the windows' places.
    """
    t, words, h, win, ranked, places = (f"{TMP}{x}" for x in ("text", "words", "h", "win", "ranked", "places"))
    df = docs.select(*keep, text_of(text_col).alias(t))
    df = df.select(
        *keep,
        t,
        F.array_remove(F.split(t, r"[\x20\x09-\x0D]+", -1), "").alias(words),
        F.filter(F.split(t, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias(f"{TMP}lines"),
    )
    df = df.select("*", F.transform(words, lambda w: F.xxhash64(w)).alias(h))
    at = lambda i, k: F.get(F.col(h), i + F.lit(k))
    df = df.withColumn(
        win,
        F.when(
            F.size(h) > WINDOW,
            F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[at(i, k) for k in range(1, WINDOW)])),
        ),
    )
    pair = lambda x, i: F.struct(x.alias("x"), i.alias("i"))
    df = df.withColumn(ranked, F.when(F.size(F.array_distinct(win)) < F.size(win), F.sort_array(F.transform(win, pair))))
    same = lambda p, k, d: F.coalesce(F.get(F.col(ranked), k + F.lit(d))["x"] == p["x"], F.lit(False))
    df = df.withColumn(
        places,
        F.when(
            F.col(ranked).isNotNull(),
            F.sort_array(F.array_compact(F.transform(ranked, lambda p, k: F.when((F.when(k > 0, same(p, k, -1)).otherwise(False)) | same(p, k, 1), p["i"])))),
        ),
    )
    covered = F.aggregate(
        F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(places), k + F.lit(1)) - p, F.lit(WINDOW)))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    lines = f"{TMP}lines"
    return df.select(
        *keep,
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.size(F.regexp_extract_all(t, F.lit("[#*$%&|<>]"), 0)).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.size(F.filter(lines, lambda s: s.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("bigint").alias("n_bullet_lines"),
        F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        F.size(F.filter(words, lambda w: w.endswith("!!"))).cast("bigint").alias("n_shouted"),
    )


def quality_rules(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), thresholds=THRESHOLDS) -> DataFrame:
    """``keep``, the measures, ``base_failed`` and ``kept``."""
    df = measure(docs, text_col, keep)
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    return df.select("*", failed.alias("base_failed"), (~failed & compile_rules(thresholds)).alias("kept"))


def oracle(thresholds=THRESHOLDS) -> str:
    """The query in DuckDB SQL."""
    rules = []
    for _, a, b, low, high in thresholds:
        ratio = f"{a}::double / nullif({b}, 0)"
        tests = [f"{ratio} >= {low}"] if low is not None else []
        tests += [f"{ratio} <= {high}"] if high is not None else []
        rules.append(f"coalesce({' and '.join(tests)}, true)")
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
with base as (
  select doc_id, coalesce(text, '') as t, row_number() over () as r from documents
), parts as (
  select r, doc_id, t,
    list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
    list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) as lines
  from base
), win as (
  select r, i, array_to_string(words[i:i+7], ' ') as g from (
    select r, words, unnest(range(1, len(words) - 6)) as i from parts where len(words) >= 8)
), rep as (
  select r, i from (select r, i, count(*) over (partition by r, g) as n from win) where n > 1
), gaps as (
  select r, least(8, coalesce(lead(i) over (partition by r order by i) - i, 8)) as c from rep
), covered as (
  select r, sum(c) as n_repeat_words from gaps group by r
), m as (
  select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    len(lines)::bigint as n_lines,
    len(list_filter(lines, lambda s: regexp_matches(s, '^[\x20\x09-\x0D]*[-*\x{{2022}}]')))::bigint as n_bullet_lines,
    len(list_filter(words, lambda w: w in ({stop})))::bigint as n_stop_words,
    len(list_filter(words, lambda w: suffix(w, '!!')))::bigint as n_shouted
  from parts left join covered using (r)
), f as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from m
)
select *, not base_failed and {' and '.join(rules)} as kept from f
"""
