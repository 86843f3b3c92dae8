"""Language identification by Bayesian evidence fusion.

    P(l | row) ~ P(text | l)^T  P(declared | l)  P(l | host)

over the languages taught and one more, ``und``: any other language, or none.

Text: byte trigrams of the lower-cased text, hashed, under multinomial models counted
over all rows of the training folds. Trigrams overlap, so their evidence is tempered,
and a long text counts as ``MOST`` trigrams. A language's own texts have a mean
log-likelihood near its negative entropy; ``und`` gives each trigram what the likeliest
language would at ``MARGIN`` below that, and ``SPREAD`` deviations of a mean over the
text's distinct trigrams. Declared markup language: how often each value goes with each
language, by grouped sums of what the texts say. Host: sums of the same for the host,
smoothed by those for its address suffix, which are smoothed by those for all rows; a
row's own part is taken out of its host's sums. So the suffix counts once, as the prior
of hosts that are rare.

Tables have a row for each value and are joined on it, never collected, and only with
rows that carry no text; only the trigram counts, a fixed size for each language, go to
the driver.

Defined results
    null or empty text, one without letters and without a declared language, or no
    language over ``CONFIDENT``: 'und', which ``language_filter`` rejects; null host,
    declaration or address: no evidence; very long texts: read whole; repeated rows: one
    result for each; ties: the language that sorts first; no training rows: 'und'; an
    empty table: no rows; further columns, whatever their names, pass through
    ``language_filter`` unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import TMP, add_up, bounded_batches, materialize, split_fold

HELD_OUT = 2
BUCKETS = 1 << 13
TEMPER = 0.25
MOST = 400
#: Pseudo-counts: of a trigram, of a declared value, and of the wider prior.
SMOOTH, DECLARED, HOST, SUFFIX = 0.5, 1.0, 20.0, 50.0
MARGIN, SPREAD = 1.75, 3.0
CONFIDENT = 0.5
UNKNOWN = "und"
MARKUP = r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})"
LETTER = re.compile(r"[^\W\d_]")


#: What a byte stands for: ASCII other than letters is a blank.
_PLAIN = np.array([b if b > 127 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def trigrams(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of a text's words, with a blank at either end and between;
    none without letters of any script."""
    text = text or ""
    if not LETTER.search(text):
        return np.zeros(0, np.uint32)
    b = _PLAIN[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]]
    return (b[:-2] * 0x9E3B + b[1:-1] * 0x1F35 + b[2:] * 0x6D) % BUCKETS


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages that occur, and the log-probabilities of trigrams in each."""
    bounded_batches(docs.sparkSession)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        n = TaskContext.get().partitionId()
        if sums:
            yield pd.DataFrame({"part": [n] * len(sums), "key": [*sums], "sums": [s.tobytes() for s in sums.values()]})

    given = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null")
    found = add_up(given, part, np.int64)
    langs = sorted(found)
    if not langs:
        return [], np.zeros((0, BUCKETS))
    counts = np.stack([found[x] for x in langs]) + SMOOTH
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def log_likelihoods(text: str | None, log_p: np.ndarray, usual: np.ndarray, spread: np.ndarray) -> np.ndarray | None:
    """The tempered log-likelihood of a text in each language and in ``und``; ``usual`` and
    ``spread``: mean and deviation of a trigram's in the language itself."""
    g = trigrams(text)
    if not len(g):
        return None
    counts = np.bincount(g, minlength=BUCKETS)
    ll = log_p @ counts
    best = int(ll.argmax())
    other = len(g) * (usual[best] - MARGIN - SPREAD * spread[best] / np.sqrt(np.count_nonzero(counts)))
    return np.append(ll, other) * (TEMPER * min(1.0, MOST / len(g)))


def text_evidence(text_col: str, log_p: np.ndarray) -> Column:
    """``ll``, the tempered log-likelihoods less the greatest, and ``p``, the same as shares;
    null without trigrams."""
    p = np.exp(log_p)
    usual = (p * log_p).sum(axis=1)
    spread = np.sqrt((p * log_p**2).sum(axis=1) - usual**2)

    @F.pandas_udf("ll array<double>, p array<double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = (log_likelihoods(t, log_p, usual, spread) for t in texts)
        out = [(None, None) if ll is None else ((ll - ll.max()).tolist(), softmax(ll).tolist()) for ll in found]
        return pd.DataFrame(out, columns=["ll", "p"], dtype=object)

    return run(F.col(text_col))


def _sums(df: DataFrame, by: list[str], n: int) -> DataFrame:
    total = F.array(*[F.sum(F.col("p")[i]) for i in range(n)])
    return df.where(F.col("p").isNotNull()).groupBy(*by).agg(total.alias("s"))


def evidence_tables(rows: DataFrame, n: int) -> dict[str, DataFrame]:
    """Tables of ``declared`` and ``host`` values of ``rows`` (with ``p``, what the texts
    say): a log-likelihood in each language, and the host's own sums with the smoothed
    prior of its suffix."""
    whole = _sums(rows, [], n).first()["s"]  # one sum for each language
    whole = F.array(*[F.lit(float(x or 0.0)) for x in whole])
    share = lambda s: F.transform(s, lambda v: (v + 1.0) / (F.aggregate(s, F.lit(0.0), lambda a, w: a + w) + n))
    per = _sums(rows.where("declared is not null"), ["declared"], n)
    likely = F.zip_with("s", whole, lambda s, a: F.log((s + DECLARED) / (a + DECLARED * n)))
    declared = per.select(F.col("declared").alias(f"{TMP}declared"), likely.alias(f"{TMP}declared_e"))
    near = _sums(rows.where("host is not null"), ["host", "suffix"], n)
    wide = near.groupBy(F.col("suffix").alias("of")).agg(F.array(*[F.sum(F.col("s")[i]) for i in range(n)]).alias("w"))
    near = near.join(wide, near["suffix"].eqNullSafe(wide["of"]), "left")
    total = F.aggregate("w", F.lit(0.0), lambda a, v: a + v)
    prior = F.zip_with("w", share(whole), lambda w, a: (w + SUFFIX * a) / (total + SUFFIX))
    host = near.select(F.col("host").alias(f"{TMP}host"), F.struct("s", prior.alias("prior")).alias(f"{TMP}host_e"))
    return {"declared": materialize(declared, "declared"), "host": materialize(host, "hosts")}


def fuse(df: DataFrame, model: tuple[list[str], np.ndarray], text: str, host: Column, declared: Column, keep: dict[str, Column]) -> DataFrame:
    """``keep`` and, under internal names, the ``declared`` language, the decision ``lang``
    and its probability ``conf``, for each row. Texts are read once, for a table of what
    they say; only its rows are joined."""
    langs, log_p = model
    bounded_batches(df.sparkSession)
    given = df.select(*[c.alias(k) for k, c in keep.items()], host.alias(f"{TMP}in_host"), F.lower(declared).alias(f"{TMP}in_declared"), *([text_evidence(text, log_p).alias(f"{TMP}text")] if langs else []))
    if not langs:
        return given.select(*keep, F.col(f"{TMP}in_declared"), F.lit(UNKNOWN).alias(f"{TMP}lang"), F.lit(0.0).alias(f"{TMP}conf"))
    classes = [*langs, UNKNOWN]
    n = len(classes)
    lean = materialize(given, "evidence")
    rows = lean.select(F.col(f"{TMP}in_host").alias("host"), F.col(f"{TMP}in_declared").alias("declared"), suffix_of(F.col(f"{TMP}in_host")).alias("suffix"), F.col(f"{TMP}text.p").alias("p"))
    tables = evidence_tables(rows, n)
    for c, table in tables.items():
        lean = lean.join(table, F.col(f"{TMP}in_{c}") == F.col(f"{TMP}{c}"), "left")

    @F.pandas_udf("lang string, conf double")
    def fused(ll: pd.Series, p: pd.Series, says: pd.Series, sums: pd.Series, prior: pd.Series) -> pd.DataFrame:
        out = []
        for x, own, d, s, w in zip(ll, p, says, sums, prior, strict=True):
            if x is None and d is None:
                out.append((UNKNOWN, 0.0))
                continue
            e = sum((np.asarray(v) for v in (x, d) if v is not None), np.zeros(n))
            if s is not None:
                left = np.maximum(np.asarray(s) - (0.0 if own is None else np.asarray(own)), 0.0)
                e = e + np.log((left + HOST * np.asarray(w)) / (left.sum() + HOST))
            post = softmax(e)
            best = int(post.argmax())
            out.append((classes[best] if post[best] >= CONFIDENT else UNKNOWN, float(post[best])))
        return pd.DataFrame(out, columns=["lang", "conf"])

    evidence = (f"{TMP}text.ll", f"{TMP}text.p", f"{TMP}declared_e", f"{TMP}host_e.s", f"{TMP}host_e.prior")
    out = lean.withColumn(f"{TMP}fused", fused(*[F.col(x) for x in evidence]))
    return out.select(*keep, f"{TMP}in_declared", F.col(f"{TMP}fused.lang").alias(f"{TMP}lang"), F.col(f"{TMP}fused.conf").alias(f"{TMP}conf"))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([A-Za-z]+)$", 1), F.lit(""))


def declared_in(html: Column) -> Column:
    marked = html.contains("<html") | html.contains("<HTML") | html.contains("<Html")
    return F.when(marked, F.nullif(F.regexp_extract(html, MARKUP, 1), F.lit("")))


def model_of(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    return train(docs.where(split_fold("doc_id") != HELD_OUT))


def identify_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, language, confidence, kept``. ``source`` is the host; markup that
    a text holds may declare its language. ``lang`` only teaches the text models, in the
    training folds."""
    df = fuse(docs, model_of(docs), "text", F.col("source"), declared_in(F.col("text")), {"doc_id": F.col("doc_id")})
    lang = F.col(f"{TMP}lang")
    return df.select("doc_id", (split_fold("doc_id") == HELD_OUT).alias("held_out"), lang.alias("language"), F.round(f"{TMP}conf", 6).alias("confidence"), (lang != UNKNOWN).alias("kept"))


def identify_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``page_id, declared, language, confidence`` with every kind of evidence."""
    host = F.lower(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1))
    host, html = F.nullif(host, F.lit("")), F.col("html")
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    given = pages.select("page_id", host.alias("host"), declared_in(html).alias("declared"), plain.alias("plain"))
    df = fuse(given, model_of(docs), "plain", F.col("host"), F.col("declared"), {"page_id": F.col("page_id")})
    return df.select("page_id", F.col(f"{TMP}in_declared").alias("declared"), F.col(f"{TMP}lang").alias("language"), F.round(f"{TMP}conf", 6).alias("confidence"))


def language_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is known. A row's result depends on its text and
    host alone, so rows go by the two hashes of both that were found unknown; that table is
    broadcast only if Spark finds it small enough."""
    # the number between them tells a null text from a null source
    keys = {f"{TMP}k{i}": F.xxhash64(F.lit(i), F.col("text"), F.lit(1), F.col("source")) for i in range(2)}
    df = fuse(docs, model_of(docs), "text", F.col("source"), declared_in(F.col("text")), keys)
    unknown = materialize(df.where(F.col(f"{TMP}lang") == UNKNOWN).select(*keys).distinct(), "unknown")
    return docs.withColumns({f"{k}_own": c for k, c in keys.items()}).join(unknown, [F.col(f"{k}_own") == F.col(k) for k in keys], "left_anti").select(*docs.columns)
