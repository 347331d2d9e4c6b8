"""Evaluation texts that leak into training text.

A document leaks an item if it holds at least 20 consecutive words of the
item's passage with at most one word in ten changed, dropped or inserted.

Filter: by the q-gram lemma, a stretch of S characters in which e words of the
passage differ keeps at least S - q + 1 - sum(len(w) + q - 1) of its q-grams, and
its shared q-grams lie on diagonals (place in the document less place in the
passage) that drift by no more than the changed words are long. So the shared
q-grams are counted in overlapping diagonal bands, and bands that meet the bound
of their passage are retained. Verification: a banded alignment by words finds,
for 0 to 3 edits, the longest stretch of the passage that ends at each place.
Three suffice: a longer match with more edits has a half that is a match itself.

The items are the broadcast side, in blocks of a stated size. Documents are read
and cleaned once for several blocks, whole, and are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessela.llm.batches import pieces, spread
from tessela.llm.markup import flat_words

LEAST_WORDS, PER_EDIT, EDITS = 20, 10, 3
_LONGEST = 40  # characters of a word in the stream of characters that is filtered; words are compared whole
_BAND = 128  # half the width of a band, at least EDITS times the longest word
_Q = (24, 12, 8, 4)
_SHARED = 12  # q-grams that a match should share at least; q is the greatest that grants it
BLOCK = 400_000  # words of passages in a block: some 60 MB in a worker at most
BLOCKS = 4  # blocks that go through the documents together
_CANDIDATES = 256  # aligned together
_HITS = 2_000_000  # shared q-grams looked at together
_RUN, _RUNS = 5, 6  # a match shares so many runs of five words: 18 of 20 words in 3 stretches hold 6, 19 in 2 hold 11, 27 of 30 in 4 hold 11


def lemma_bound(lengths: Sequence[int], q: int) -> int:
    """The least number of q-grams that any match of the passage must share."""
    least = None
    for n in range(LEAST_WORDS, min(len(lengths), PER_EDIT * (EDITS + 1) - 1) + 1, PER_EDIT):
        e = n // PER_EDIT
        for i in range(len(lengths) - n + 1):
            part = lengths[i : i + n]
            bound = sum(part) - q + 1 - sum(x + q - 1 for x in sorted(part)[-e:])
            least = bound if least is None else min(least, bound)
    return least if least is not None else 0


def passage_table(passages: Sequence[tuple[int, list[bytes]]]) -> dict:
    """What the workers need of the passages: their q-grams by hash, bounds and words."""
    vocabulary: dict[bytes, int] = {}
    table: dict = {"keys": [], "words": [], "runs": [], "chars": [], "bound": [], "grams": {}, "vocabulary": vocabulary}
    by_q = defaultdict(list)
    for key, words in passages:
        lengths = [min(len(w), _LONGEST) for w in words]
        bounds = {q: lemma_bound(lengths, q) for q in _Q}
        q = next((q for q in _Q if bounds[q] >= _SHARED), max(_Q, key=bounds.get))
        bound = max(1, bounds[q])
        by_q[q].append((len(table["keys"]), b"".join(w[:_LONGEST] for w in words)))
        table["keys"].append(key)
        table["words"].append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int32))
        table["runs"].append(np.unique(gram_hashes(table["words"][-1], _RUN)))
        table["chars"].append(sum(lengths))
        table["bound"].append(bound)
    for q, texts in by_q.items():
        own, at, code = [], [], []
        for p, text in texts:
            h = gram_hashes(_bytes(text), q)
            own.append(np.full(len(h), p, np.int32))
            at.append(np.arange(len(h), dtype=np.int32))
            code.append(h)
        own, at, code = map(np.concatenate, (own, at, code))
        order = np.argsort(code, kind="stable")
        own, at, code = own[order], at[order], code[order]
        seen = np.zeros(1 << 22, bool)
        seen[(code >> np.uint64(42)).astype(np.int64)] = True
        distinct, start = np.unique(code, return_index=True)
        table["grams"][q] = (np.packbits(seen), distinct, np.r_[start, len(code)], own, at)
    return table


def _bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q-gram at each place, by doubling: q a sum of powers of two."""
    base = np.uint64(0x9E3779B97F4A7C15)
    power, width, now, done, out = base, 1, chars.astype(np.uint64) + np.uint64(1), 0, None
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        while True:
            if q & width:
                piece = now[done : done + n]
                out = piece.copy() if out is None else out * power + piece
                done += width
            if width * 2 > q:
                break
            now = now[:-width] * power + now[width:]
            power, width = power * power, width * 2
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def _candidates(chars: np.ndarray, doc_start: np.ndarray, table: dict) -> tuple[np.ndarray, ...]:
    """Document, passage, first and last band number of the bands that meet their passage's bound, neighbours as one.

    ``chars`` holds the documents one after the other, each ended by a zero.
    """
    found = []
    bound, size = np.array(table["bound"]), len(table["keys"])
    for q, (packed, distinct, start, own, at) in table["grams"].items():
        seen = table.setdefault(("seen", q), np.unpackbits(packed).view(bool))
        codes = gram_hashes(chars, q)
        place = np.flatnonzero(seen[(codes >> np.uint64(42)).astype(np.int64)])
        row = np.searchsorted(distinct, codes[place])
        hit = (row < len(distinct)) & (distinct[np.minimum(row, len(distinct) - 1)] == codes[place])
        place, row = place[hit], row[hit]
        many = start[row + 1] - start[row]
        if not len(many):
            continue
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        cuts = np.searchsorted(np.cumsum(many), np.arange(_HITS, int(many.sum()) + _HITS, _HITS), "left") + 1
        low = 0
        for high in np.minimum(cuts, len(many)).tolist():  # a common q-gram meets many passages: only so many hits are spelled out at a time
            if high > low:
                n, p, r = many[low:high], place[low:high], row[low:high]
                entry = np.repeat(start[r] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
                p = np.repeat(p, n)
                doc = np.searchsorted(doc_start, p, "right") - 1
                band = (p - doc_start[doc] - at[entry]) // _BAND + (1 << 20)
                counts.append(np.unique((doc * size + own[entry].astype(np.int64)) << 22 | band, return_counts=True))
                low = high
        code, back = np.unique(np.concatenate([c for c, _ in counts]), return_inverse=True)
        n = np.bincount(back, np.concatenate([x for _, x in counts]), len(code)).astype(np.int64)
        # A band and the next make one of the overlapping bands.
        follows = np.r_[code[1:] == code[:-1] + 1, False] if len(code) else np.zeros(0, bool)
        pair = n + np.where(follows, np.r_[n[1:], 0], 0)
        found.append(code[pair >= bound[(code >> 22) % size]])
    code = np.sort(np.concatenate([np.zeros(0, np.int64), *found]))
    if not len(code):
        return tuple(np.zeros((4, 0), np.int64))
    opens = np.flatnonzero(np.r_[True, code[1:] > code[:-1] + 1])
    last = np.r_[opens[1:], len(code)] - 1
    pair, band = code[opens] >> 22, (1 << 22) - 1
    return pair // size, pair % size, (code[opens] & band) - (1 << 20), (code[last] & band) - (1 << 20)


def aligned(passages: Sequence[np.ndarray], regions: Sequence[np.ndarray]) -> np.ndarray:
    """Which regions hold a match of their passage; words as numbers, 0 for words of no passage."""
    k, m, r = len(passages), max(map(len, passages)), max(map(len, regions))
    p, d = np.full((m, k, 1), -1, np.int32), np.zeros((k, r), np.int32)
    for i, (x, y) in enumerate(zip(passages, regions)):
        p[: len(x), i, 0] = x
        d[i, : len(y)] = y
    low = np.int16(-1000)
    # far[e][i, j]: words of the passage in the longest stretch with e edits that ends before word j of region i.
    far = [np.zeros((k, r + 1), np.int16) for _ in range(EDITS + 1)]
    won = np.zeros(k, bool)
    for i in range(m):
        real = p[i] >= 0
        same = (d == p[i]) & real
        new = []
        for e in range(EDITS + 1):
            step = np.full((k, r + 1), 0 if e == 0 else low, np.int16)
            step[:, 1:] = np.where(same, far[e][:, :-1] + 1, step[:, 1:])
            if e:
                before = far[e - 1]
                np.maximum(step[:, 1:], before[:, :-1] + 1, out=step[:, 1:])  # changed
                np.maximum(step, before + 1, out=step)  # dropped
                np.maximum(step[:, 1:], new[e - 1][:, :-1], out=step[:, 1:])  # inserted
            new.append(step)
            won |= ((step >= max(LEAST_WORDS, PER_EDIT * e)) & real).any(axis=1)
        far = new
        if won.all():
            break
    return won


def cleaned(texts: Sequence[str | None]) -> tuple[list[list[bytes]], np.ndarray]:
    """The words of the documents, and their characters one document after the other, each ended by a zero."""
    words = [flat_words(t) if t else [] for t in texts]
    stream = b"\0".join(b"".join(ws if max(map(len, ws), default=0) <= _LONGEST else [w[:_LONGEST] for w in ws]) for ws in words) + b"\0"
    return words, _bytes(stream)


def scan(words: Sequence[list[bytes]], chars: np.ndarray, table: dict) -> list[tuple[int, int]]:
    """(place of the document, key of the passage) for every passage that one of the ``cleaned`` documents holds."""
    doc_start = np.r_[0, np.flatnonzero(chars == 0)[:-1] + 1]
    vocabulary = table["vocabulary"]
    numbers: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    retained = []
    for x, p, first, last in zip(*(a.tolist() for a in _candidates(chars, doc_start, table))):
        if x not in numbers:
            ids = np.array([vocabulary.get(w, 0) for w in words[x]], np.int32)
            numbers[x] = np.cumsum(np.minimum([0, *map(len, words[x])], _LONGEST)), ids, gram_hashes(ids, _RUN)
        ends, ids, runs = numbers[x]
        low = max(0, int(np.searchsorted(ends, (first - 1) * _BAND - _LONGEST)))
        high = int(np.searchsorted(ends, (last + 3) * _BAND + table["chars"][p] + _LONGEST))
        if np.count_nonzero(np.isin(runs[low:high], table["runs"][p])) >= _RUNS:
            retained.append((len(table["words"][p]), x, p, ids[low:high]))
    retained.sort(key=lambda c: c[:3])
    known: dict[tuple[int, int], None] = {}
    for at in range(0, len(retained), _CANDIDATES):
        some = retained[at : at + _CANDIDATES]
        won = aligned([table["words"][p] for _, _, p, _ in some], [region for *_, region in some])
        known.update({(x, table["keys"][p]): None for (_, x, p, _), yes in zip(some, won) if yes})
    return list(known)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, item_id``: every document with every item whose passage it holds, fully or partly.

    Case, punctuation, spacing, markup, references and ways of writing characters
    don't count; templates, comments and tables are searched too. Items that share
    a passage are found together. Null and empty texts hold nothing, passages of
    fewer than 20 words can't be held, repeated rows give one row, and empty
    tables give none. Only the named columns are read.

    The items are a query set: their passages come to the driver one block of
    about ``block`` words at a time and are sent out from there; ``BLOCKS`` blocks
    go through the documents in one pass, in which each text is cleaned once, in
    pieces of bounded bytes. The documents stay where they are.
    """
    spark = docs.sparkSession
    held = items.where("passage IS NOT NULL AND item_id IS NOT NULL").groupBy("passage").agg(F.collect_set(F.col("item_id").cast("long")).alias("items"))
    kind = docs.schema[id_col].dataType.simpleString()
    source = spread(docs.select(id_col, text_col).where(F.length(text_col) >= LEAST_WORDS))

    def blocks() -> Iterator[list[tuple[list[int], list[bytes]]]]:
        part, size = [], 0
        for text, own in held.toLocalIterator():
            words = flat_words(text)
            if len(words) >= LEAST_WORDS:
                if size and size + len(words) > block:
                    yield part
                    part, size = [], 0
                part.append((own, words))
                size += len(words)
        if part:
            yield part

    def search(sent: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for some in pieces(batches):
                words, chars = cleaned(some.column(1).to_pylist())
                rows = [(x, item) for b in sent for x, key in scan(words, chars, b.value[0]) for item in b.value[1][key]]
                where = pa.array([x for x, _ in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0).take(where), pa.array([i for _, i in rows], pa.int64())], names=["doc_id", "item_id"])

        return source.mapInArrow(run, f"doc_id {kind}, item_id long")

    parts, sent = [], []
    for part in blocks():
        sent.append(spark.sparkContext.broadcast((passage_table([(k, w) for k, (_, w) in enumerate(part)]), [own for own, _ in part])))
        if len(sent) == BLOCKS:
            parts.append(search(sent))
            sent = []
    if sent:
        parts.append(search(sent))
    if not parts:
        return source.select(F.col(id_col).alias("doc_id"), F.lit(None).cast("long").alias("item_id")).limit(0)
    return reduce(DataFrame.unionByName, parts).distinct()
