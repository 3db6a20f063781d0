"""Secrets: fixed patterns, then formats inferred from labelled credentials.

From the labelled credentials of each format a prefix tree over character
classes is built; states whose continuation counts are statistically compatible
(Hoeffding bound, red-blue order) are merged into a probabilistic automaton.
Every long token is scored by the log-likelihood ratio of its best automaton, with each character uniform within its class, against the
letter pairs of the whole corpus. A token is a run of the characters that occur
in credentials; below the threshold its pieces between "=", then between "/",
are scored in its place. Tokens above the threshold that do not lie inside a
pattern match are added to the pattern matches, which always stay.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from itertools import accumulate
from math import log, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 or more; a shorter run can't hold a longer match
_HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "format")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")  # whole runs, however long
_ASSIGNED, _STEP = re.compile(r"[^=]{16,}"), re.compile(r"[^=/]{16,}")

#: Bits a character by which a token must be likelier under a format than as ordinary text.
THRESHOLD_BITS = 1.5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the pattern matches, by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


# Classes: digit, a-f, g-z, A-F, G-Z, and each other character by itself.
_CLASS = {c: k for k, cs in (("d", string.digits), ("h", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("H", "ABCDEF"), ("U", "GHIJKLMNOPQRSTUVWXYZ")) for c in cs}
_SIZE = {"d": 10, "h": 6, "l": 20, "H": 6, "U": 20}


def classes(s: str) -> str:
    return "".join(_CLASS.get(c, c) for c in s)


def sample_credentials(per_format: int = 200, seed: int = 7) -> list[tuple[str, str]]:
    """(format, credential): made-up credentials in publicly documented shapes, as labelled examples."""
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choices(chars, k=n))
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    shapes = {
        "prefixed": lambda: rng.choice(("ghp_", "gho_", "ghs_")) + pick(alnum, 36),
        "live_key": lambda: rng.choice(("sk_live_", "pk_live_", "rk_test_")) + pick(alnum, 24),
        "api_key": lambda: "AIza" + pick(alnum + "-_", 35),
        "base64_40": lambda: pick(b64, 40),
        "hex_upper": lambda: pick("0123456789ABCDEF", rng.choice((32, 40, 64))),
        "uuid": lambda: "-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
        "bot_token": lambda: f"xoxb-{pick(string.digits, 12)}-{pick(string.digits, 12)}-{pick(alnum, 24)}",
    }
    return [(k, f()) for k, f in shapes.items() for _ in range(per_format)]


@dataclass
class _Node:
    n: int = 0
    stop: int = 0
    out: dict[str, int] = field(default_factory=dict)  # symbol -> node
    count: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton merged from the prefix tree of ``words`` (class strings)."""

    def __init__(self, words: list[str], alpha: float = 0.02) -> None:
        self.nodes = [_Node()]
        for w in words:
            at = 0
            for c in w:
                x = self.nodes[at]
                x.n += 1
                x.count[c] = x.count.get(c, 0) + 1
                if c not in x.out:
                    self.nodes.append(_Node())
                    x.out[c] = len(self.nodes) - 1
                at = x.out[c]
            self.nodes[at].n += 1
            self.nodes[at].stop += 1
        self._bound = sqrt(0.5 * log(2 / alpha))
        self._infer()

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self._bound * (1 / sqrt(n1) + 1 / sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            x, y = self.nodes[p], self.nodes[q]
            if self._differ(x.stop, x.n, y.stop, y.n):
                return False
            for c in x.count.keys() | y.count.keys():
                if self._differ(x.count.get(c, 0), x.n, y.count.get(c, 0), y.n):
                    return False
                if c in x.out and c in y.out and x.out[c] != y.out[c]:
                    todo.append((x.out[c], y.out[c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree under ``b`` to ``a``."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            x, y = self.nodes[p], self.nodes[q]
            x.n += y.n
            x.stop += y.stop
            for c, k in y.count.items():
                x.count[c] = x.count.get(c, 0) + k
                if c in x.out:
                    if x.out[c] != y.out[c]:
                        todo.append((x.out[c], y.out[c]))
                else:
                    x.out[c] = y.out[c]

    def _infer(self) -> None:
        red = [0]
        while True:
            blue = sorted({(v, r, c) for r in red for c, v in self.nodes[r].out.items() if v not in red})
            if not blue:
                break
            v, r, c = blue[0]
            for u in red:
                if self._compatible(u, v):
                    self.nodes[r].out[c] = u
                    self._fold(u, v)
                    break
            else:
                red.append(v)
        keep = {old: new for new, old in enumerate(red)}
        self.step = [{c: keep[v] for c, v in self.nodes[r].out.items()} for r in red]
        self.bits = [{c: log2((k + 0.1) / (self.nodes[r].n + 1)) for c, k in self.nodes[r].count.items()} for r in red]
        self.end = [log2((self.nodes[r].stop + 0.1) / (self.nodes[r].n + 1)) for r in red]
        del self.nodes

    def score(self, word: str) -> float:
        """log2 probability of a class string; -inf where a symbol has no transition."""
        at, total = 0, 0.0
        for c in word:
            b = self.bits[at].get(c)
            if b is None:
                return float("-inf")
            total += b
            at = self.step[at][c]
        return total + self.end[at]


def infer_automata(labelled: list[tuple[str, str]]) -> dict[str, Automaton]:
    by: dict[str, list[str]] = {}
    for kind, s in labelled:
        by.setdefault(kind, []).append(classes(s))
    return {k: Automaton(v) for k, v in by.items()}


def _ordinary(text: str) -> str:
    """``text`` without the tokens that are candidates themselves."""
    return _TOKEN.sub(" ", text)


def pair_bits(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log2 P(b | a) of adjacent lower-cased bytes over all texts but for candidates (128 x 128; non-ASCII bytes count as 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(128 * 128, dtype=np.int64)
        for b in batches:
            for t in b.column(0):
                raw = np.frombuffer(_ordinary(t.as_py() or "").encode().lower(), dtype=np.uint8)
                for lo in range(0, len(raw) - 1, 1 << 20):  # a long text in parts that share a byte
                    x = raw[lo : lo + (1 << 20) + 1].astype(np.int32)
                    x[x > 127] = 0
                    total += np.bincount(x[:-1] * 128 + x[1:], minlength=128 * 128)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["pair", "n"])

    counts = np.full(128 * 128, 0.05)
    for pair, n in docs.select(text_col).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n")).toLocalIterator():
        counts[pair] += n  # at most 16,384 rows
    counts = counts.reshape(128, 128)
    return np.log2(counts / counts.sum(axis=1, keepdims=True))


class FormatScorer:
    """Adds spans that look like a credential of some format."""

    def __init__(self, automata: dict[str, Automaton], bits: np.ndarray, threshold: float = THRESHOLD_BITS) -> None:
        self.automata, self.bits, self.threshold = automata, bits, threshold

    def score(self, token: str) -> float:
        """Bits a character by which the best format beats ordinary text."""
        cls = classes(token)
        best = max((a.score(cls) for a in self.automata.values()), default=float("-inf"))
        if best == float("-inf"):
            return best
        uniform = -sum(log2(_SIZE.get(c, 1)) for c in cls)
        x = np.frombuffer((" " + token).lower().encode(), dtype=np.uint8)
        return (best + uniform - float(self.bits[x[:-1], x[1:]].sum())) / len(token)

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        starts, ends = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))

        def found(a: int, b: int) -> bool:
            before = bisect_right(starts, a)
            inside = before > 0 and ends[before - 1] >= b
            return not inside and self.score(text[a:b]) >= self.threshold

        def tokens(a: int, b: int) -> Iterator[tuple[int, int]]:
            if found(a, b):
                yield a, b
                return
            for m in _ASSIGNED.finditer(text, a, b):
                if m.span() != (a, b) and found(*m.span()):
                    yield m.span()
                    continue
                yield from (x.span() for x in _STEP.finditer(text, *m.span()) if x.span() != m.span() and found(*x.span()))

        return [(a, 3, b) for m in _TOKEN.finditer(text) for a, b in tokens(*m.span())]


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_OUT = "n_assign bigint, n_access bigint, n_hex bigint, base string, spans string"


def scan_secrets(docs: DataFrame, labelled: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD_BITS) -> DataFrame:
    """One row per input row: id, counts by pattern kind, ``base`` and ``spans`` as ``kind:start:end`` lists.

    Positions are code points, end exclusive. ``labelled`` are (format, credential)
    pairs; None takes made-up ones. Null texts are empty and have no spans. A text or
    token of any length is scored whole, in time in proportion to it and memory of a
    few times its size. Rows with null or repeated ids stay as they are; an empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    scorer = FormatScorer(infer_automata(sample_credentials() if labelled is None else labelled), pair_bits(docs, text_col), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*n, _join(base), _join(sorted(base + scorer.spans(text, base)))))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[id_col, "n_assign", "n_access", "n_hex", "base", "spans"]
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {_OUT}")


def op7_secrets(docs: DataFrame) -> DataFrame:
    d = scan_secrets(docs)
    return d.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def brute_force_base(text: str | None) -> tuple[int, int, int, str]:
    """Counts and digest of the pattern matches, straight from the definitions."""
    found = []
    for i, p in enumerate((r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+")):
        for m in re.finditer(p, text or ""):
            if len(m[2] if i == 0 else m[0]) >= (12, 18, 16)[i]:
                found.append((m.start(), i, m.end()))
    n = [sum(k == i for _, k, _ in found) for i in range(3)]
    return (*n, sha256(_join(sorted(found)).encode()).hexdigest())
