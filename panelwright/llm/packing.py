"""Best-fit packing of documents into sequences, by local search.

A document is its token ids and a closing id; only a document longer than a sequence is
cut. Pieces are dealt out evenly to tasks, ``GROUP`` to each. There they get first bins,
best fit in the order they come and once more longest first, and local search exchanges
documents between underfull bins - a move, one for one, two for one - wherever that
increases the sum of squared fills, until bins empty and no exchange is left. The fewer
bins count.

Bins that stay underfull are open: the emptiest of each group, with half its pieces at
most, are dealt anew and searched on together with those of other groups. A round so has
half as many groups as the one before at most, and the last one is a single group.
A group whose underfull bins hold more than half its pieces keeps the fuller of them.
Lengths are shuffled, never texts.

Defined results
    null or empty text: the closing id alone; very long texts: cut, every token kept;
    repeated rows and equal lengths: each is packed, which of equal ones goes where is
    open; an empty table: no pieces; further columns of the input are left out. Bin
    numbers mean nothing beyond telling bins apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.bpe import ChunkEncoder, encoder
from panelwright.llm.common import bounded_batches, drop, materialize

SIZE = 2048
CLOSING_ID = 0
GROUP = 65_536


def cut(ids: bytes, size: int = SIZE) -> Iterator[tuple[int, int, int, int]]:
    """``piece, start, length, crc32`` of the pieces of a document's ids (4 bytes each)."""
    for k, at in enumerate(range(0, len(ids), 4 * size)):
        part = ids[at : at + 4 * size]
        yield k, at // 4, len(part) // 4, zlib.crc32(part)


def pieces(docs: DataFrame, path: str, size: int = SIZE, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    content = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
    closing = CLOSING_ID.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(content.value, ChunkEncoder).encode
        for b in batches:
            rows = [(i, *p) for i, t in enumerate(b["text"]) for p in cut(encode(t or "")[0] + closing, size)]
            out = pd.DataFrame(rows, columns=["at", "piece", "start", "length", "ids_crc32"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy()[out.pop("at").to_numpy()])
            yield out

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(given.dtypes)["doc_id"]
    # an id that may be null travels as text, as pandas would turn it into a float
    given = given.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = given.mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def best_fit(lengths: np.ndarray, size: int = SIZE) -> np.ndarray:
    """First bins, in the order given: the fullest bin that still has room. Bins are found
    by their free space through one bit for each amount that is on offer."""
    bins = np.empty(len(lengths), np.int64)
    offered: list[list[int]] = [[] for _ in range(size + 1)]
    mask, n = 0, 0
    for i, x in enumerate(lengths.tolist()):
        rest = mask >> x
        if rest:
            free = x + (rest & -rest).bit_length() - 1
            b = offered[free].pop()
            if not offered[free]:
                mask ^= 1 << free
            free -= x
        else:
            b, n = n, n + 1
            free = size - x
        bins[i] = b
        if free:
            offered[free].append(b)
            mask |= 1 << free
    return bins


class Exchanges:
    """Local search over underfull bins.

    A document of y tokens in a bin with ``free`` room can be replaced by up to y + free
    tokens: its capacity. So x tokens of bin d - one document, or two - go to a place of
    capacity c >= x, and the document y < x that was there comes back. Empty room is such
    a place with y = 0, which makes a move. The exchange leaves c - x free there, and the
    sum of squared fills rises exactly if that is less than d had free.

    Places are kept by capacity and y, with a bit for each of both that is on offer, so an
    exchange is found without looking at other bins. The sum rises with each exchange, so
    the search ends; it ends early only where no packing has fewer bins.
    """

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, size: int):
        self.size, self.total = size, int(lengths.sum())
        self.bins = bins.tolist()
        self.held: dict[int, dict[int, list[int]]] = {}
        self.fill: dict[int, int] = {}
        for i, (b, x) in enumerate(zip(self.bins, lengths.tolist(), strict=True)):
            self.held.setdefault(b, {}).setdefault(x, []).append(i)
            self.fill[b] = self.fill.get(b, 0) + x
        self.at: list[dict[int, set[int]]] = [{} for _ in range(size + 1)]
        self.lengths_at = [0] * (size + 1)
        self.offered = 0
        for b in self.fill:
            self._offer(b)

    def _offer(self, b: int) -> None:
        free = self.size - self.fill[b]
        if 0 < free < self.size:
            for y in (0, *self.held[b]):
                c = y + free
                self.at[c].setdefault(y, set()).add(b)
                self.lengths_at[c] |= 1 << y
                self.offered |= 1 << c

    def _withdraw(self, b: int) -> None:
        free = self.size - self.fill[b]
        if 0 < free < self.size:
            for y in (0, *self.held[b]):
                c = y + free
                left = self.at[c][y]
                left.discard(b)
                if not left:
                    del self.at[c][y]
                    self.lengths_at[c] ^= 1 << y
                    if not self.lengths_at[c]:
                        self.offered ^= 1 << c

    def _place(self, x: int, free: int) -> tuple[int, int] | None:
        """The least capacity from x, and under x + ``free``, with a document under x."""
        window = (self.offered >> x) & ((1 << free) - 1)
        while window:
            low = window & -window
            c = x + low.bit_length() - 1
            lengths = self.lengths_at[c]
            y = (lengths & -lengths).bit_length() - 1
            if y < x:
                return c, y
            window ^= low
        return None

    def _shift(self, x: int, a: int, b: int) -> None:
        """One document of x tokens from bin a to bin b."""
        here = self.held[a]
        i = here[x].pop()
        if not here[x]:
            del here[x]
        self.held[b].setdefault(x, []).append(i)
        self.fill[a] -= x
        self.fill[b] += x
        self.bins[i] = b

    def _once(self, d: int) -> bool:
        free, own = self.size - self.fill[d], sorted(self.held[d], reverse=True)
        for given in self._gifts(d, own):
            found = self._place(sum(given), free)
            if found:
                c, y = found
                b = next(iter(self.at[c][y]))
                self._withdraw(b)
                for x in given:
                    self._shift(x, d, b)
                if y:
                    self._shift(y, b, d)
                self._offer(b)
                return True
        return False

    def _gifts(self, d: int, own: list[int]) -> Iterator[tuple[int, ...]]:
        for x in own:
            yield (x,)
        for i, x in enumerate(own):
            for y in own[i if len(self.held[d][x]) > 1 else i + 1 :]:
                if x + y <= self.size:
                    yield x, y

    def run(self) -> np.ndarray:
        least, used = -(-self.total // self.size), sum(1 for f in self.fill.values() if f)
        changed = True
        while changed and used > least:
            changed = False
            for d in sorted((b for b, f in self.fill.items() if 0 < f < self.size), key=self.fill.__getitem__):
                if not 0 < self.fill[d] < self.size or used == least:
                    continue
                self._withdraw(d)
                while self.fill[d] and self._once(d):
                    changed = True
                used -= not self.fill[d]
                self._offer(d)
        return np.array(self.bins, np.int64)


def improve(lengths: np.ndarray, bins: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The bins after local search: no exchange is left, or no packing has fewer."""
    return Exchanges(lengths, bins, size).run() if len(lengths) else bins.copy()

def search(lengths: np.ndarray, size: int = SIZE, bins: np.ndarray | None = None) -> np.ndarray:
    """The fewest bins of local search from first bins of two kinds: ``bins``, or else best
    fit in the order given, and best fit longest first."""
    order = np.argsort(-lengths, kind="stable")
    longest = np.empty(len(lengths), np.int64)
    longest[order] = best_fit(lengths[order], size)
    found = [improve(lengths, first, size) for first in (best_fit(lengths, size) if bins is None else bins, longest)]
    return min(found, key=lambda b: len(np.unique(b)))


def places(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Each piece's offset in its bin."""
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.r_[True, np.diff(bins[order]) != 0][: len(order)]
    offset = np.empty(len(bins), np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    return offset


PIECE = "doc_id string, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECE}, sequence_id long, offset long, open boolean"


def packed(rows: pd.DataFrame, bins: np.ndarray, names: np.ndarray, keep_open: int, size: int) -> pd.DataFrame:
    """``rows`` in their bins (0, 1, ...), which are called ``names``; the emptiest stay open,
    with ``keep_open`` pieces at most."""
    lengths = rows["length"].to_numpy(np.int64)
    fill, pieces_in = np.bincount(bins, lengths).astype(np.int64), np.bincount(bins)
    order = np.argsort(fill, kind="stable")
    is_open = np.zeros(len(fill), bool)
    is_open[order[np.cumsum(pieces_in[order]) <= keep_open]] = True
    is_open &= fill < size
    return rows.assign(sequence_id=names[bins], offset=places(lengths, bins), open=is_open[bins])


def _first_round(df: DataFrame, groups: int, group: int, size: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, held, count = TaskContext.get().partitionId() << 40, [], 0

        def flush() -> pd.DataFrame:
            nonlocal base
            rows = pd.concat(held, ignore_index=True)
            bins = np.unique(search(rows["length"].to_numpy(np.int64), size), return_inverse=True)[1]
            names = base + np.arange(bins.max() + 1)
            base += len(names)
            return packed(rows, bins, names, group // 2 if groups > 1 else 0, size)

        for b in batches:
            held.append(b)
            count += len(b)
            if count >= 2 * group:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    return df.repartition(groups).mapInPandas(run, PACKED)


def _next_round(df: DataFrame, groups: int, group: int, size: int) -> DataFrame:
    """Whole bins are dealt to ``groups`` groups; the bins there keep their names."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, bins = np.unique(rows["sequence_id"].to_numpy(np.int64), return_inverse=True)
        lengths = rows["length"].to_numpy(np.int64)
        found = np.unique(search(lengths, size, bins), return_inverse=True)[1]
        return packed(rows[PIECES], found, names, group // 2 if groups > 1 else 0, size)

    dealt = F.pmod(F.xxhash64("sequence_id"), F.lit(groups))
    return df.groupBy(dealt.alias("dealt")).applyInPandas(run, PACKED)


PIECES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pack(docs: DataFrame, path: str, size: int = SIZE, text_col: str = "text", id_col: str = "doc_id", group: int = GROUP) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    group = max(2, group)
    todo = materialize(pieces(docs, path, size, text_col, id_col), "pieces")
    kind = dict(todo.dtypes)["doc_id"]
    groups = max(1, -(-todo.count() // group))
    rounds = [materialize(_first_round(todo.withColumn("doc_id", F.col("doc_id").cast("string")), groups, group, size), "packed")]
    drop(todo)
    while groups > 1:
        left = rounds[-1].where("open").drop("open", "offset")
        groups = min(-(-left.count() // group), -(-groups // 2))
        if groups:
            rounds.append(materialize(_next_round(left, groups, group, size), "packed"))
    found = rounds[-1]
    for earlier in rounds[:-1]:
        found = found.unionByName(earlier.where("not open"))
    return found.select(F.col("doc_id").cast(kind).alias("doc_id"), *PIECES[1:], "sequence_id", "offset")
