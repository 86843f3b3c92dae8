"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one last token in its encoding. An automaton
of all tokens reports, at each place, the tokens that end there; such a token is the
last one of the prefix if the encoding of what precedes it is empty or ends in a token
with which it is compatible: encoded side by side, the two stay as they are. Whether
they do follows from the merges alone: the pieces along the right edge of one and the
left edge of the other are tried for a merge that would come before each piece is used
up. One last token for each prefix gives back-pointers, and following them from the
end of the word gives the ids. The work grows with a word's length, not its square.

Words repeat, so workers keep the encodings of white-space separated chunks, at most
``CACHE`` of them; what is kept changes the time only.

Defined results
    null or empty text: no ids, decoded to ''; very long texts and words: encoded whole;
    the strings of special tokens in a text are those tokens, as the library has it;
    repeated rows: one result for each; an empty table: no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import TMP, bounded_batches

CACHE = 300_000
END = "</w>"
#: Texts with one of these go through the library's own normalizer and word splitter:
#: beyond U+024F lower case, composition and white space are not those of Python.
UNUSUAL = re.compile("[\x1c-\x1fɐ-\U0010ffff]")


def byte_symbols() -> list[str]:
    """The printable stand-ins of byte-level vocabularies, by byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class ChunkEncoder:
    """Splits texts as the library does and looks chunks up; words that are new are encoded
    by the library's model. ``decode``: keep the decoded text too."""

    def __init__(self, content: str, decode: bool = False):
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(content)
        self.decode = decode
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.library = Tokenizer.from_str(content)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.symbols = byte_symbols()
        self.text = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.known: dict[str, tuple[bytes, str]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given in byte symbols."""
        return [t.id for t in self.library.model.tokenize(word)]

    def _pack(self, words: list[str]) -> tuple[bytes, str]:
        ids = [i for w in words for i in self.encode_word(w)]
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.text[i] for i in ids]) if self.decode else ""

    def _word(self, word: str) -> tuple[bytes, str]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            plain = word if word.isascii() and word.isprintable() else "".join([self.symbols[b] for b in word.encode()])
            found = self.known[word] = self._pack([plain])
        return found

    def chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and decoded text, of a lower-cased chunk
        without white space. Letters alone are one word, whatever the pattern."""
        if chunk.isalpha():
            return self._word(chunk)
        if chunk[:-1].isalpha() and not chunk[-1].isalnum():
            (ids, text), (mark, sign) = self._word(chunk[:-1]), self._word(chunk[-1])
            return ids + mark, f"{text} {sign}"
        if len(self.chunks) >= CACHE:
            self.chunks.clear()
        words = [self._word(w) for w in self.words.findall(chunk)]
        found = self.chunks[chunk] = (b"".join([i for i, _ in words]), " ".join([d for _, d in words]))
        return found

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        if UNUSUAL.search(text):
            normal = self.library.normalizer.normalize_str(text)
            return [self._pack([w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)])]
        known, chunks, chunk = self.known, self.chunks, self.chunk
        return [known.get(c) or chunks.get(c) or chunk(c) for c in text.lower().split()]

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and the decoded text."""
        if not (self.special and "<|" in text):
            found = self._plain(text)
        else:
            found = []
            for part in self.special_split.split(text):
                found += [(struct.pack("<I", self.special[part]), part)] if part in self.special else self._plain(part)
        return b"".join([i for i, _ in found]), " ".join([d for i, d in found if i]) if self.decode else ""


class PrefixEncoder(ChunkEncoder):
    """The same, with new words encoded by dynamic programming over prefixes."""

    def __init__(self, content: str, decode: bool = True):
        import ahocorasick

        super().__init__(content, decode)
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in json.loads(content)["model"]["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): r for r, (a, b) in enumerate(pairs)}
        made = {self.vocab[a + b]: (r, self.vocab[a], self.vocab[b]) for r, (a, b) in enumerate(pairs)}
        if len(made) != len(pairs) or any(made.get(x, (-1,))[0] > r for r, a, b in made.values() for x in (a, b)):
            raise ValueError("the merges do not build each token once, from earlier tokens")
        never = len(pairs)
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        reached = set()
        self.automaton = ahocorasick.Automaton()
        for token, i in sorted(self.vocab.items(), key=lambda x: made.get(x[1], (-1,))[0]):
            rank, a, b = made.get(i, (never, None, None))
            self.right[i] = [(i, never)] + ([(b, rank), *self.right[b][1:]] if b is not None else [])
            self.left[i] = [(i, never)] + ([(a, rank), *self.left[a][1:]] if a is not None else [])
            if a is None or (a in reached and b in reached and self._meet(a, b) == rank):
                reached.add(i)
                last = token.endswith(END) and token != END
                key = (token[: -len(END)] if last else token) + "\0" * last
                self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}

    def _meet(self, a: int, b: int) -> int | None:
        """The rank of the first merge across the border of ``a`` and ``b``, if any."""
        ranks = [m for x, used_x in self.right[a] for y, used_y in self.left[b] if (m := self.rank.get((x, y))) is not None and m < used_x and m <= used_y]
        return min(ranks, default=None)

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= 8 * CACHE:
                self.fits.clear()
            found = self.fits[key] = self._meet(a, b) is None
        return found

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given in byte symbols. The word's end is a place of its own, so
        that tokens ending there are told from tokens that end on the last symbol."""
        n = len(word) + 1
        last = [-1] * (n + 1)
        back = [0] * (n + 1)
        fits, compatible = self.fits, self.compatible
        for end, (token, size) in self.automaton.iter(word + "\0"):
            place = end + 1
            if last[place] < 0:
                before = place - size
                if before:
                    previous = last[before]
                    if previous < 0:
                        continue
                    fit = fits.get(previous << 32 | token)
                    if fit is False or (fit is None and not compatible(previous, token)):
                        continue
                last[place], back[place] = token, before
        ids = []
        while n:
            ids.append(last[n])
            n = back[n]
        return ids[::-1]


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(content: str, kind: type[ChunkEncoder] = PrefixEncoder) -> ChunkEncoder:
    """One encoder for each worker, kind and tokenizer file."""
    key = (kind, hashlib.sha256(content.encode()).hexdigest())
    if key not in _ENCODERS:
        _ENCODERS[key] = kind(content)
    return _ENCODERS[key]


def encode_texts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit) and ``decoded``. The tokenizer
    file is read on the driver; its size does not depend on the data."""
    spark = docs.sparkSession
    bounded_batches(spark)
    content = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    @F.pandas_udf("ids binary, decoded string")
    def run(texts: pd.Series) -> pd.DataFrame:
        encode = encoder(content.value).encode
        return pd.DataFrame([encode(t or "") for t in texts], columns=["ids", "decoded"])

    return docs.withColumn(f"{TMP}e", run(F.col(text_col))).withColumns({"ids": F.col(f"{TMP}e.ids"), "decoded": F.col(f"{TMP}e.decoded")}).drop(f"{TMP}e")


def bpe_digests(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, number of ids, and digests of ids and of the decoded text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    content = spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        encode, digest = encoder(content.value).encode, hashlib.sha256
        rows = [(len(i) // 4, digest(i).hexdigest(), digest(d.encode()).hexdigest()) for i, d in (encode(t or "") for t in texts)]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(*keep, run(F.col(text_col)).alias(f"{TMP}d")).select(*keep, f"{TMP}d.*")
