"""Packing token sequences by order-preserving dynamic programming.

The documents of a partition form one stream of tokens, in order. A plan cuts
the stream into windows of at most ``capacity`` tokens; its cost is the padding
of all windows plus a penalty for each cut that is not between documents: small
after a sentence, large inside one. With positions p and cut penalties c(p),

    best(j) = c(j) + min over i in [j - capacity, j) of best(i) + capacity - (j - i),

so the minimum of best(i) + i over a sliding window is all a transition needs;
a monotone queue gives it in constant time. A window whose length is a power of
two needs no padding, which adds one direct transition for each power.

Cuts may also fall inside a sentence: each position ``capacity`` after a
candidate is a candidate too, as are the powers of two before the stream's end.
The stream is planned in blocks; all but the last few windows of a block are
kept and the rest is planned again with what follows, so memory is bounded.
No row leaves its partition: the partitions of a file scan are the same when a
lost task runs again, and so are the sequence ids.
"""

from __future__ import annotations

import base64
import json
import re
import sys
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from types import ModuleType
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.rows import column


@dataclass(frozen=True)
class PackingConfig:
    capacity: int = 2048
    sentence_penalty: float = 2.0
    inside_penalty: float = 24.0
    window_cost: float = 1.0  # so that of plans that pad alike the one with fewer windows wins
    end_id: int = 1  # appended to each document
    block_tokens: int = 1 << 18
    vocabulary: str = "byte_bpe_50k"
    folder: str | None = None  # where the vocabulary files are; None: the installed public tokenizers


def _process_cache() -> dict:
    """A dictionary that lives as long as the process.

    Functions of this package are pickled by value, so what their module holds is
    new in every task; an encoder costs half a second and tens of megabytes.
    """
    return sys.modules.setdefault("isochron_process_cache", ModuleType("isochron_process_cache")).__dict__


#: What may end a sentence; blanks may follow.
_MARKS = (".", "!", "?", "\n", "\u3002", "\uff01", "\uff1f", "\u2026", "\u061f", "\u06d4", "\u0964", "\u0965", "\u1362", "\u17d4")
_WIDE = re.compile("[" + "".join(m for m in _MARKS if not m.isascii()) + "]")
#: Long texts are tokenized in pieces of about so many characters.
_PIECE_CHARS = 1 << 20
#: A lone blank between other characters; a token never goes across its left side.
_SEAM = re.compile(r"(?<=\S) (?=\S)")


class Tokens:
    """Ids and sentence ends of a text, as the JSON vocabulary file gives them, its added tokens included.

    The rank file holds the same vocabulary and gives the same ids several times
    faster; the added tokens, which it lacks, are split off before.
    """

    def __init__(self, vocabulary: str, folder: str | None) -> None:
        import public_tokenizers
        import tiktoken

        at = lambda name: f"{folder}/{name}" if folder else public_tokenizers.path(name)
        with open(at(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(at(f"{vocabulary}.json"), encoding="utf-8") as f:
            self.added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self._split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        enc = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._encode = lambda text: np.array(enc.encode_ordinary(text), dtype=np.uint32)
        self.size = np.zeros(max([*ranks.values(), *self.added.values()]) + 1, dtype=np.int64)  # bytes of each token
        self._mark, self._blank = np.zeros((2, len(self.size)), dtype=bool)  # does it end with an ASCII mark, blanks aside; is it all blanks
        ascii_marks = tuple(m.encode() for m in _MARKS if m.isascii())
        for token, i in [*ranks.items(), *((x.encode(), i) for x, i in self.added.items())]:
            self.size[i] = len(token)
            self._mark[i] = token.rstrip(b" ").endswith(ascii_marks)
            self._blank[i] = not token.strip(b" ")

    def _plain(self, text: str) -> np.ndarray:
        out, at = [], 0
        while len(text) - at > _PIECE_CHARS and (seam := _SEAM.search(text, at + _PIECE_CHARS)):
            out.append(self._encode(text[at : seam.start()]))
            at = seam.start()
        last = self._encode(text[at:] if at else text)
        return np.concatenate([*out, last]) if out else last

    def encode(self, text: str) -> np.ndarray:
        if self._split is None or not any(x in text for x in self.added):
            return self._plain(text)
        ids = [np.array([self.added[x]], dtype=np.uint32) if k % 2 else self._plain(x) for k, x in enumerate(self._split.split(text))]
        return np.concatenate(ids)

    def sentence_ends(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Which tokens end where a sentence does: the text up to there ends with a mark, blanks aside."""
        if not _WIDE.search(text):  # no token splits an ASCII mark
            blank = self._blank[ids]
            if not blank.any():
                return self._mark[ids]
            last = np.maximum.accumulate(np.where(blank, -1, np.arange(len(ids))))
            return (last >= 0) & self._mark[ids[last]]
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        if not len(raw):
            return np.zeros(len(ids), dtype=bool)
        mark = np.zeros(len(raw), dtype=bool)
        for m in _MARKS:
            b = m.encode()
            if len(b) == 1:
                mark |= raw == b[0]
            elif m in text:
                at = np.flatnonzero(raw == b[-1])
                at = at[at >= len(b) - 1]
                for k in range(len(b) - 1):
                    at = at[raw[at - len(b) + 1 + k] == b[k]]
                mark[at] = True
        last = np.maximum.accumulate(np.where(raw == 32, -1, np.arange(len(raw))))  # the last byte that is no blank
        before = last[np.cumsum(self.size[ids]) - 1]
        return (before >= 0) & mark[before]


def _tokens(vocabulary: str, folder: str | None) -> Tokens:
    key = f"tokenizer {folder}/{vocabulary}"
    cache = _process_cache()
    if key not in cache:
        cache[key] = Tokens(vocabulary, folder)
    return cache[key]


def plan_cuts(n: int, penalty: dict[int, float], capacity: int, inside: float, window_cost: float = 0.0) -> list[int]:
    """Cut positions (0 < p <= n, the last n) of least cost over a stream of ``n`` tokens.

    ``penalty`` has the candidates and what cutting there costs; positions
    ``capacity`` after a candidate and, at the end, sums of powers of two are
    added at ``inside``.
    """
    if n == 0:
        return []
    cand = dict(penalty)
    cand[n] = 0.0
    for p in [0, *penalty]:
        cand.setdefault(p + capacity, inside)
    at = 0
    for p in sorted(penalty) + [n]:  # stretches without a candidate
        while p - at > capacity:
            at += capacity
            cand.setdefault(at, inside)
        at = p
    rest, at = n % capacity, n
    while rest:  # the stream's last tokens in powers of two
        low = rest & -rest
        at -= low
        rest -= low
        cand.setdefault(at, inside)
    pos = np.array(sorted(p for p in cand if 0 < p <= n), dtype=np.int64)
    positions = pos.tolist()
    costs = [cand[p] + window_cost for p in positions]
    # which candidates lie a power of two before each: of all such pairs only those that exist
    there = np.zeros(n + 1, dtype=bool)
    there[pos] = there[0] = True
    rows, from_ = [], []
    for q in (1 << k for k in range(capacity.bit_length())):
        at_q = np.flatnonzero((pos >= q) & there[np.maximum(pos - q, 0)])
        rows.append(at_q)
        from_.append(pos[at_q] - q)
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    direct = np.concatenate(from_)[order].tolist()
    first = np.searchsorted(row[order], np.arange(len(pos) + 1)).tolist()
    best = [0.0] * (n + 1)
    back = [0] * (n + 1)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # best(i) + i, ascending
    for r, j in enumerate(positions):
        while queue[0][1] < j - capacity:
            queue.popleft()
        value, i = queue[0]
        cost = value + capacity - j
        for x in direct[first[r] : first[r + 1]]:
            if best[x] < cost:
                cost, i = best[x], x
        cost += costs[r]
        best[j], back[j] = cost, i
        value = cost + j
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    out = [n]
    while back[out[-1]]:
        out.append(back[out[-1]])
    return out[::-1]


class _Packer:
    """Pieces of one partition; ``sequence`` counts up from ``first``."""

    def __init__(self, cfg: PackingConfig, first: int) -> None:
        self.cfg, self.sequence = cfg, first
        # id, ids not yet placed, which of them end a sentence, ids before them, ids of the whole document
        self.docs: deque[tuple[object, np.ndarray, np.ndarray, int, int]] = deque()
        self.size = 0
        self.rows: list[tuple] = []
        self.tokens = _tokens(cfg.vocabulary, cfg.folder)

    def add(self, doc_id: object, text: str | None) -> None:
        ids = self.tokens.encode(text or "")
        ends = np.append(self.tokens.sentence_ends(text or "", ids), False)
        ids = np.append(ids, np.uint32(self.cfg.end_id))
        for at in range(0, len(ids), self.cfg.block_tokens):  # a plan covers no more than two blocks, however long the text
            part = slice(at, at + self.cfg.block_tokens)
            self.docs.append((doc_id, ids[part], ends[part], at, len(ids)))
            self.size += len(ids[part])
            if self.size >= self.cfg.block_tokens:
                self.place(final=False)

    def place(self, final: bool) -> None:
        cfg = self.cfg
        penalty: dict[int, float] = {}
        at = 0
        for _, ids, ends, before, total in self.docs:
            penalty.update(dict.fromkeys((np.flatnonzero(ends) + 1 + at).tolist(), cfg.sentence_penalty))
            at += len(ids)
            if before + len(ids) == total:
                penalty[at] = 0.0
        cuts = plan_cuts(at, penalty, cfg.capacity, cfg.inside_penalty, cfg.window_cost)
        if not final:
            cuts = cuts[: max(1, len(cuts) - 8)]
        start = 0
        for cut in cuts:
            self._emit(cut - start)
            start = cut
        self.size = at - start

    def _emit(self, length: int) -> None:
        offset = 0
        while offset < length:
            doc_id, ids, ends, before, total = self.docs.popleft()
            n = min(len(ids), length - offset)
            piece = ids[:n]
            self.rows.append((doc_id, before, n, crc32(piece.astype("<u4").tobytes()), total, self.sequence, offset))
            if n < len(ids):
                self.docs.appendleft((doc_id, ids[n:], ends[n:], before + n, total))
            offset += n
        self.sequence += 1


_COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, cfg: PackingConfig = PackingConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one token, the end id. Rows with a null id or the same
    id are packed like any other. A long text is tokenized in pieces and planned in
    blocks; of all of it the ids are held (some 20 bytes a character in all). An
    empty table gives no rows. Other columns are ignored, whatever their names.
    Sequence ids are unique over all partitions and ascend in each.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(cfg, TaskContext.get().partitionId() << 33)

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.rows, strict=True)) or [[]] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=[id_col, *_COLUMNS])

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, text.as_py())
                if len(packer.rows) > 100_000:
                    yield out()
            if packer.rows:
                yield out()
        packer.place(final=True)
        if packer.rows:
            yield out()

    return docs.select(column(id_col), column(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, " + ", ".join(f"{c} bigint" for c in _COLUMNS))


def padding(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: sequences, tokens and padding tokens (none for a length that is a power of two)."""
    seqs = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.bit_count("n") == 1, 0).otherwise(capacity - F.col("n"))
    return seqs.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(pad).alias("padding"))


def op1_packing(docs: DataFrame) -> DataFrame:
    return pack(docs)
