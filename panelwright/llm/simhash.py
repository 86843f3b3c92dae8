"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; bit k is 1 if it is set in more than half the hashes of the
text's word shingles. Spark makes the hashes (XXH64, seed 42); one Arrow-batched
function adds up their bits.

Search is exact. Bits are given non-zero vectors of GF(2)^(R+1); table v keeps the bits
whose vector has an odd product with v. For any R bits some v has an even product with
all of them, so two fingerprints that differ in at most R bits are equal under some of
the 2^(R+1) - 1 masks. Only distinct fingerprints are hashed: copies meet before. Within
a bucket a spanning forest of the links is enough for components, so a bucket of b
fingerprints gives fewer than b edges, not all pairs. A bucket over ``CHUNK`` is dealt into
chunks, and every two chunks meet in a task of their own: no task holds more than two
chunks, and no fingerprint is left out.

Defined results
    null or empty text, or white space alone: fingerprint 0, linked like any other;
    under three words: one shingle of all words; very long texts: read whole, their
    hashes summed in parts; repeated rows and equal texts: one component; null ids: a row each, never a component's id unless it has no other;
    an empty table: no rows; further columns of the input, whatever their names, are left
    out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import TMP, ascii_lower, bounded_batches, materialize, text_of
from panelwright.llm.components import connected_components

WORDS = 3
RADIUS = 3
CHUNK = 4096
BLOCK = 65_536


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The masks of the tables, as unsigned integers."""
    tables = 2 ** (radius + 1) - 1
    vector = [1 + k % tables for k in range(bits)]
    return [sum(1 << k for k in range(bits) if (vector[k] & v).bit_count() % 2) for v in range(1, tables + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), r"[\x20\x09-\x0D]+", -1), "")


def _hashes(words: str, n: int = WORDS) -> Column:
    whole = F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " "))))
    at = lambda i, k: F.get(F.col(words), i + F.lit(k))
    parts = lambda w, i: F.xxhash64(F.concat_ws(" ", w, *[at(i, k) for k in range(1, n)]))
    many = F.transform(F.slice(F.col(words), F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0))), parts)
    return F.when(F.size(words) >= n, many).otherwise(whole)


def majority(hashes: pa.ListArray) -> np.ndarray:
    """For each list of 64-bit hashes, the bits set in over half of them."""
    offsets = hashes.offsets.to_numpy()
    values = hashes.values.to_numpy(zero_copy_only=False).astype("<i8", copy=False)
    out = np.zeros(len(hashes), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b > a:
            ones = np.zeros(64, np.int64)
            for s in range(a, b, BLOCK):
                part = values[s : min(b, s + BLOCK)]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = weights[2 * ones > b - a].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "fp") -> DataFrame:
    """``keep`` and, under ``name``, the fingerprint as a signed 64-bit integer."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def fold(hashes: pa.Array) -> pa.Array:
        return pa.array(majority(hashes.fill_null([]) if hashes.null_count else hashes).view(np.int64))

    words = f"{TMP}words"
    df = docs.select(*keep, shingle_words(text_of(text_col)).alias(words))
    return df.select(*keep, fold(F.coalesce(_hashes(words), F.array().cast("array<bigint>"))).alias(name))


def _near(nodes: np.ndarray, radius: int):
    """For a bucket's fingerprints: which of ``rest`` are linked to fingerprint ``f``."""
    bits = nodes.view(np.uint64)
    return lambda f, rest: np.bitwise_count(bits[rest] ^ bits[f]) <= radius


def forest(near, first: np.ndarray) -> list[tuple[int, int]]:
    """Places of the edges of a spanning forest of the links in a bucket. Where ``first``
    is mixed, only links between the two kinds count: the others are another task's."""
    cross = first.any() and not first.all()
    rest = np.arange(len(first))
    edges = []
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            f = front.pop()
            hit = near(f, rest)
            if cross:
                hit &= first[rest] != first[f]
            if hit.any():
                new, rest = rest[hit].tolist(), rest[~hit]
                edges += [(f, k) for k in new]
                front += new
    return edges


def bucket_cells(keyed: DataFrame, schema: str, solve, chunk: int = CHUNK, data: DataFrame | None = None) -> DataFrame:
    """What ``solve(key, rows, first)`` lists for all buckets of ``keyed`` (v, key, node).

    ``data`` (node and more) is what solving needs beyond the node; only members of shared
    buckets get it. Buckets of one are left out first; those over ``chunk`` are dealt into
    chunks and each two chunks meet once: ``first`` tells theirs apart, and is true
    throughout where a chunk is by itself.
    """
    sizes = keyed.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes.select("v", "key", F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("chunks")), "buckets")
    spread, rest = keyed.join(sizes.hint("merge"), ["v", "key"]), ["node"]
    if data is not None:
        spread, rest = spread.join(data.hint("merge"), "node"), data.columns
    spread = spread.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    spread = spread.select("v", "key", "own", *rest, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    spread = spread.select("v", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *rest)
    cell = ["v", "key", "i", "j"]
    dealt = spread.repartition(*cell).sortWithinPartitions(*cell, "own", "node")
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def solved(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            keys = rows[cell].to_numpy()
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            own, found = rows["own"].to_numpy(), []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
                first = own[s:e] == keys[s, 2]
                if e - s > 1 and (keys[s, 2] == keys[s, 3] or not first.all()):
                    found += solve(int(keys[s, 1]), rows.iloc[s:e], first)
            if found:
                yield pd.DataFrame(found, columns=names)

        for b in batches:
            rows = b if held is None else pd.concat([held, b], ignore_index=True)
            if not len(rows):
                continue
            last = (rows[cell] == rows[cell].iloc[-1]).all(axis=1).to_numpy()
            k = int(np.flatnonzero(last)[0])
            if k:
                yield from solved(rows.iloc[:k])
            held = rows.iloc[k:].reset_index(drop=True)
        if held is not None and len(held):
            yield from solved(held)

    return dealt.mapInPandas(run, schema)


def bucket_links(keyed: DataFrame, near_of, chunk: int = CHUNK, data: DataFrame | None = None) -> DataFrame:
    """``a, b`` edges of spanning forests of all buckets; ``near_of(rows)`` gives the link
    test of a bucket."""

    def solve(key: int, rows: pd.DataFrame, first: np.ndarray) -> list[tuple[int, int]]:
        nodes = rows["node"].to_numpy(np.int64)
        return [(nodes[x], nodes[y]) for x, y in forest(near_of(rows), first)]

    return bucket_cells(keyed, "a long, b long", solve, chunk, data)


def links(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """``a, b``: edges whose components are those of all links among distinct ``fp``."""
    masks = F.array(*[F.struct(F.lit(i).alias("v"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(covering_masks(radius))])
    keyed = prints.select("fp", F.explode(masks).alias("t"))
    keyed = keyed.select(F.col("fp").alias("node"), F.col("t.v").alias("v"), F.col("fp").bitwiseAND(F.col("t.m")).alias("key"))
    return bucket_links(keyed, lambda rows: _near(rows["node"].to_numpy(np.int64), radius), chunk)


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(``id, fp`` of every row, ``fp, root`` of every distinct fingerprint)."""
    prints = materialize(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), "prints")
    distinct = materialize(prints.select("fp").distinct(), "distinct")
    found = connected_components(links(distinct, radius))
    roots = distinct.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return prints, materialize(roots, "roots")


def simhash_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    prints, roots = classes(docs, text_col, id_col, radius)
    # the least id of a fingerprint first, then of its component: one small row for each fingerprint
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp")
    names = least.groupBy("root").agg(F.min("least").alias("component_id")).join(roots, "root").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
