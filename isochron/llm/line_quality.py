"""Document quality rules and cross-document line frequency.

Base counts come from one pass over the words and lines of each text. The
verdict adds what only the whole table shows: each line is normalised and hashed,
its distinct documents per host (the ``source`` column) are counted, lines in
more than the limit are removed, and a document that loses too much is rejected.
A document is an id; copies under several ids are several documents, so the lines
of a text that a host has many copies of are above the limit too.

Texts are read once. What is kept of each row (counts, and hash and words of its
distinct lines) goes to the checkpoint folder; the counts of documents and the
join with the lines above the limit start from there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.plans.runtime import cut_lineage

#: A line is boilerplate if more documents of its host have it; the limit is the same for hosts of any size.
MOST_DOCUMENTS = 20
#: A document is depleted if lines with more than this share of its words are removed.
DEPLETED = 0.6
#: Lines above the limit are broadcast up to this many (24 bytes each); more are joined by a shuffle that splits hot keys.
BROADCAST_LINES = 1_000_000
#: Texts over so many bytes are counted without Python objects for their words.
LONG_BYTES = 1 << 20

_SYMBOLS = b"#*$%&|<>"
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text; null is empty."""
    raw = (text or "").encode()
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    if len(raw) > LONG_BYTES:
        return _long_counts(raw, symbols)
    words = raw.split()  # at 0x20 and 0x09-0x0D
    n_words = len(words)
    chars = len(b"".join(words).decode())
    lines = [x for x in raw.split(b"\n") if x.split()] if n_words else []
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n_words >= 3:
        rows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(rows)
        if len(counts) < len(rows):
            upto = 0  # words before this one are counted
            for i, r in enumerate(rows):
                if counts[r] > 1:
                    repeat += i + 3 - max(upto, i)
                    upto = i + 3
    return n_words, chars, symbols, dup, repeat


def _long_counts(raw: bytes, symbols: int) -> tuple[int, int, int, int, int]:
    """The same of a long text: lines one at a time, words as numbers (some 50 bytes a word, and the distinct words and lines)."""
    chars = 0
    for lo in range(0, len(raw), LONG_BYTES):
        part = np.frombuffer(raw, dtype=np.uint8, count=min(LONG_BYTES, len(raw) - lo), offset=lo)
        chars += int(((part & 0xC0 != 0x80) & (part != 32) & ((part < 9) | (part > 13))).sum())
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(m[0], len(number)) for m in _WORD.finditer(raw)), dtype=np.int64)
    distinct, filled, at = set(), 0, 0
    while at <= len(raw):
        end = raw.find(b"\n", at)
        end = len(raw) if end < 0 else end
        if _WORD.search(raw, at, end):
            filled += 1
            distinct.add(sha256(raw[at:end]).digest())
        at = end + 1
    repeat = 0
    if len(ids) >= 3:
        k = len(number)
        _, pair = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)
        _, row, times = np.unique(pair * k + ids[2:], return_inverse=True, return_counts=True)
        again = times[row] > 1
        inside = np.zeros(len(ids), dtype=bool)
        for i in range(3):
            inside[i : len(again) + i] |= again
        repeat = int(inside.sum())
    return len(ids), chars, symbols, filled - len(distinct), repeat


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def normalised(line: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _read(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(_row, _id, _doc, _host, the base counts, _total, _lines) of every row, in the checkpoint folder.

    _doc tells documents apart: the id, or for a null one the text. _lines has the
    hash of each distinct normalised line with a word and the words of all its copies.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    line = lambda x: F.struct(F.xxhash64(x).alias("h"), F.when(x == "", 0).otherwise(F.size(F.split(x, " "))).alias("w"))
    lined = docs.select(
        F.col(id_col).alias("_id"),
        text.alias("_text"),
        F.when(F.col(id_col).isNull(), F.xxhash64(text)).alias("_null"),
        F.coalesce(F.col(host_col), F.lit("")).alias("_host"),
        F.filter(F.transform(F.transform(F.split(text, "\n", -1), normalised), line), lambda x: x["w"] > 0).alias("_lines"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [base_counts(t.as_py()) for t in b.column(1)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            lines = b.column(4)
            values = lines.flatten()
            owner = np.repeat(np.arange(b.num_rows), lines.value_lengths().to_numpy())
            flat = pa.table({"i": owner, "h": values.field("h"), "w": values.field("w")}).group_by(["i", "h"]).aggregate([("w", "sum")]).sort_by("i")
            i, w = flat["i"].to_numpy(), flat["w_sum"].to_numpy()
            offsets = pa.array(np.searchsorted(i, np.arange(b.num_rows + 1)).astype(np.int32))
            pairs = pa.StructArray.from_arrays([pa.array(flat["h"].to_numpy()), pa.array(w)], ["h", "w"])
            total = np.bincount(i, w, minlength=b.num_rows).astype(np.int64) if len(i) else np.zeros(b.num_rows, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), *[pa.array(c, pa.int64()) for c in cols], pa.array(total), pa.ListArray.from_arrays(offsets, pairs)],
                names=["_id", "_null", "_host", *_COUNTS, "_total", "_lines"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    counted = lined.mapInArrow(run, f"_id {id_type}, _null bigint, _host string, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", _total bigint, _lines array<struct<h:bigint,w:bigint>>")
    return cut_lineage(counted.withColumn("_row", F.monotonically_increasing_id()))


def _frequent(read: DataFrame, most: int) -> DataFrame:
    """(_host, h) of the lines that more than ``most`` documents of the host have.

    Rows are made distinct by (host, line, document) before they meet by line, so a
    line that every document has is counted in parts.
    """
    rows = read.select("_host", "_id", "_null", F.explode("_lines").alias("x")).select("_host", "x.h", "_id", "_null").distinct()
    return rows.groupBy("_host", "h").agg(F.count("*").alias("df")).where(F.col("df") > most).select("_host", "h")


def boilerplate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most: int = MOST_DOCUMENTS) -> DataFrame:
    """(host, h): hashes of the normalised lines above the limit of their host. A null host is the host ""."""
    return _frequent(_read(docs, id_col, text_col, host_col), most).withColumnRenamed("_host", "host")


def judge_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most: int = MOST_DOCUMENTS, broadcast: int = BROADCAST_LINES
) -> DataFrame:
    """One row per row of ``docs``: id, the base counts, base_failed, removed_words (in removed lines), kept.

    Null and empty texts have zero counts and fail the base rule (fewer than 50
    words). Repeated rows stay repeated and are one document; rows with a null id
    are one document for each text; a null host is the host "". Of a long text the
    words are held as numbers, some ten bytes a character. An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    read = _read(docs, id_col, text_col, host_col)
    bad = cut_lineage(_frequent(read, most))
    bad = F.broadcast(bad) if bad.count() <= broadcast else bad
    lines = read.select("_row", "_host", F.explode("_lines").alias("x")).select("_row", "_host", "x.h", "x.w")
    removed = lines.join(bad, ["_host", "h"]).groupBy("_row").agg(F.sum("w").alias("_removed"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost = F.coalesce("_removed", F.lit(0).cast("bigint"))
    return read.drop("_lines").join(removed, "_row", "left").select(
        F.col("_id").alias(id_col),
        *_COUNTS,
        failed.alias("base_failed"),
        lost.alias("removed_words"),
        (~failed & (lost <= DEPLETED * F.col("_total"))).alias("kept"),
    )


def op3_line_quality(docs: DataFrame) -> DataFrame:
    return judge_documents(docs).drop("removed_words")
