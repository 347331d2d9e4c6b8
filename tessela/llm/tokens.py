"""Encoding of whole corpora with a public byte-level BPE vocabulary.

The merge of a word keeps its symbols in a doubly linked list and the candidate
pairs in a priority queue by rank; entries whose symbols have changed since are
stale and skipped when they come up. Words repeat without end in a corpus, so
each worker keeps what it has merged, in tables of bounded size.

A text is cut before each single space that stands between two characters that
aren't white space. The vocabulary's pattern can match across no such place and
looks at nothing beyond it, so the pieces may be encoded one by one.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessela.llm.batches import pieces, spread

#: The folder of public vocabularies; a parameter of every function.
FOLDER = os.environ.get("TESSELA_TOKENIZERS", "/opt/tokenizers")
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the vocabulary's own pattern, white space written out.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _SPACE + r"\p{L}\p{N}]+|[" + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + "]+"
)
_BLANK = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
_KEPT = 300_000  # pieces, and words, that a worker remembers at most


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks (ids) of a vocabulary file: a token in base64 and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    token = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, width = heapq.heappop(queue)
        left = token[i]
        if not left or (j := after[i]) >= n or len(left) + len(token[j]) != width:
            continue  # stale: one of the two symbols has grown or gone
        token[i], token[j] = left + token[j], b""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            both = token[i] + token[k]
            if (r := ranks.get(both)) is not None:
                heapq.heappush(queue, (r, i, len(both)))
        if (h := before[i]) >= 0:
            both = token[h] + token[i]
            if (r := ranks.get(both)) is not None:
                heapq.heappush(queue, (r, h, len(both)))
    return [ranks[t] for t in token if t]


class _Irregular(Exception):
    """A piece that doesn't begin and end with other than white space."""


class _Pieces(dict):
    """From a piece to the bytes of the ids of a space and the piece."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0] in _BLANK or piece[-1] in _BLANK:
            raise _Irregular
        return self.add(piece)

    def add(self, piece: str) -> bytes:
        if len(self) >= _KEPT:
            self.clear()
        self[piece] = found = self.encoder.slow(" " + piece)
        return found


class Encoder:
    """Encodes texts; ids come as bytes of little-endian 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.words: dict[str, bytes] = {}
        self.find = regex.compile(PATTERN).findall
        self.pieces = _Pieces(self)

    def slow(self, text: str) -> bytes:
        out, words = [], self.words
        for word in self.find(text):
            ids = words.get(word)
            if ids is None:
                if len(words) >= _KEPT:
                    words.clear()
                words[word] = ids = np.array(merge_word(word.encode(), self.ranks), "<i4").tobytes()
            out.append(ids)
        return b"".join(out)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        split = text.split(" ")
        pieces = self.pieces
        if split[0] and split[0][-1] not in _BLANK:
            try:
                return b"".join([self.slow(split[0]), *[pieces[p] for p in split[1:]]])
            except _Irregular:
                pass
        # Where white space meets a split, the pieces on both sides belong together.
        groups, now, loose = [], split[0], not split[0] or split[0][-1] in _BLANK
        for p in split[1:]:
            if loose or not p or p[0] in _BLANK:
                now = f"{now} {p}"
            else:
                groups.append(now)
                now = p
            loose = not p or p[-1] in _BLANK
        groups.append(now)
        known = pieces.get
        return b"".join([self.slow(groups[0]), *[known(g) or pieces.add(g) for g in groups[1:]]])


_encoders: dict[int, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    """This process's encoder of a vocabulary, kept between tasks."""
    if (key := hash(data)) not in _encoders:
        _encoders[key] = Encoder(read_ranks(data))
    return _encoders[key]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = FOLDER) -> DataFrame:
    """``doc_id, ids``: the token ids of every row's text, without special tokens.

    Empty and null texts have the empty list. Strings of special tokens in a text
    are ordinary text. Each row is encoded whole and by itself: no shuffle, and
    repeated ids or texts simply give their rows again.
    """
    with open(os.path.join(folder, vocabulary), "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # a file of under 1 MB
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for part in pieces(batches):
            found = [encoder(t) if t else b"" for t in part.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[id_col, "ids"])

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = FOLDER) -> DataFrame:
    """``doc_id, text``: the texts again, by concatenating the tokens' strings. Null ids give null."""
    with open(os.path.join(folder, vocabulary), "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: text for text, rank in read_ranks(shared.value).items()}
        for batch in batches:
            texts = [None if ids is None else b"".join(map(token.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def token_counts(encoded: DataFrame) -> DataFrame:
    """``token, n``: how often each id occurs."""
    return encoded.select(F.explode("ids").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
