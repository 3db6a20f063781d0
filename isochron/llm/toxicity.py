"""Toxicity from a learned lexicon, misspellings included, weighed by the words around.

The lexicon is learned from labelled rows. It is kept as a trie; the Levenshtein
automata of all its terms are intersected with it, which gives one deterministic
table (state x letter class -> state) that accepts every term and every word
within its edit limit. The table is run over all words of a batch at once, one
letter a step, and a word leaves as soon as it reaches the dead state.

Each match is weighed by its edit distance and its context window: inside
quotation marks or after a reporting word it counts little, near a second
person a bit more. Words that clean training texts use themselves are no
misspellings, and the rest of the near matches count only beyond the rate at
which clean training texts have them. A logistic model turns the sum of the
weights and its density into a score.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.llm.packing import _process_cache
from isochron.llm.simhash import fingerprint

#: Most labelled rows the lexicon and the model are learned from, and most of their characters.
TRAIN_ROWS = 8_000
TRAIN_CHARS = 60_000_000
#: A term must be in this share of the distinct toxic texts, and this much likelier there.
LEAST_SHARE = 0.01
LEAST_RATIO = 8.0
#: Terms have so many letters at least, or two where a letter is a syllable or word; under four they match as they are only.
LEAST_LETTERS = 3
_SYLLABLES = "\u2e80"  # scripts from here on
SCORE_LIMIT = 0.7

_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_SPLIT = set(" \t\n\r\x0b\x0c,;:()[]{}\"/\\|&=<>?“”«»„…、。，．！？：；（）「」『』【】\xa0  \x85")
_CUT = re.compile("[\\s" + re.escape("".join(sorted(_SPLIT))) + "]")
_BLANK, _GONE = 0, 0xFFFF
#: Texts go through the table so many characters at a time.
PIECE_CHARS = 1 << 20
_QUOTES = re.compile("[\"“”«»„]")
_REPORT = re.compile(r"\b(?:said|says|say|wrote|writes|called|calls|quote[ds]?|quoting|term|word|slur|so-called|reported|dit|sagte|dijo)\b", re.I)
_SECOND = re.compile(r"\b(?:you|your|you're|u|ur|du|dein|tu|toi|vous|usted)\b", re.I)


def edit_limit(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 10 else 2


def near_weight(term: str, distance: int) -> float:
    """What share of a term's weight a word at this distance has; less for four letters, which many words are near to."""
    return 0.2 if len(term) < 5 else 0.4 if distance == 1 else 0.25


def _kinds() -> tuple[np.ndarray, np.ndarray, dict[str, list[int]]]:
    """Of all code points: class without a lexicon (1 for any letter or digit), whether a letter; and the code points of each lower-case letter."""
    cache = _process_cache()
    if "toxicity kinds" in cache:
        return cache["toxicity kinds"]
    kind, is_letter = np.full(sys.maxunicode + 1, _GONE, dtype=np.uint16), np.zeros(sys.maxunicode + 1, dtype=bool)
    of: dict[str, list[int]] = defaultdict(list)
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if c in _SPLIT or c.isspace():
            kind[cp] = _BLANK
        elif c.isalnum() or c in _LEET:
            kind[cp] = 1
            is_letter[cp] = c.isalpha()
            of[_LEET.get(c, c.lower())].append(cp)
    cache["toxicity kinds"] = kind, is_letter, of
    return cache["toxicity kinds"]


class LexiconAutomaton:
    """The trie of ``terms`` intersected with their Levenshtein automata, as a table."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = sorted(set(terms))
        self._table = self._is_letter = None
        letters = sorted({c for t in self.terms for c in t})
        self.letter = {c: i + 1 for i, c in enumerate(letters)}
        self.other = len(letters) + 1
        child: list[dict[int, int]] = [{}]
        last: dict[int, int] = {}
        reach = [0]
        for k, t in enumerate(self.terms):
            at, limit = 0, edit_limit(t)
            reach[0] = max(reach[0], limit)
            for c in t:
                x = self.letter[c]
                if x not in child[at]:
                    child.append({})
                    reach.append(0)
                    child[at][x] = len(child) - 1
                at = child[at][x]
                reach[at] = max(reach[at], limit)
            last[at] = k

        def close(states: dict[int, int]) -> frozenset:
            """Add what deletions reach; keep the least errors of each node."""
            todo = list(states.items())
            while todo:
                node, e = todo.pop()
                if states[node] < e:
                    continue
                for c in child[node].values():
                    if e + 1 <= reach[c] and e + 1 < states.get(c, 9):
                        states[c] = e + 1
                        todo.append((c, e + 1))
            return frozenset(states.items())

        def step(states: frozenset, x: int) -> frozenset:
            out: dict[int, int] = {}
            for node, e in states:
                if e + 1 <= reach[node]:  # one letter too many
                    out[node] = min(out.get(node, 9), e + 1)
                for c, to in child[node].items():
                    cost = e + (c != x)
                    if cost <= reach[to]:
                        out[to] = min(out.get(to, 9), cost)
            return close(out)

        start = close({0: 0})
        number = {frozenset(): 0, start: 1}
        table, queue = [[0] * (self.other + 1)], [start]
        while queue:
            s = queue.pop(0)
            row = [0] * (self.other + 1)
            for x in range(1, self.other + 1):
                to = step(s, x)
                if to not in number:
                    number[to] = len(number)
                    queue.append(to)
                row[x] = number[to]
            table.append(row)
        # queue order equals numbering order, so rows are in place
        self.table = np.array(table, dtype=np.int32)
        self.accept = np.full(len(number), -1, dtype=np.int32)
        self.distance = np.full(len(number), 9, dtype=np.int8)
        for s, i in number.items():
            for node, e in sorted(s, key=lambda x: last.get(x[0], 0)):  # of equally near terms the first
                if node in last and e <= edit_limit(self.terms[last[node]]) and e < self.distance[i]:
                    self.accept[i], self.distance[i] = last[node], e
        self.kind = {letter: of for c, letter in self.letter.items() if (of := _kinds()[2].get(c))}  # class -> code points

    def classes(self, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, is it a letter) of each code point."""
        if self._table is None:
            kind, self._is_letter, _ = _kinds()
            self._table = np.where(kind == 1, self.other, kind).astype(np.uint16)
            for letter, of in self.kind.items():
                self._table[of] = letter
        return self._table[cp], self._is_letter[cp]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None, "_is_letter": None}  # made anew by each process

    def find(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, start, end, term, distance) of each matching word; positions in code points."""
        offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
        cp = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind, is_letter = self.classes(cp)
        sign = (cp == 64) | (cp == 36) | (cp == 33)  # @ $ !
        if sign.any():  # a sign stands for a letter only before one
            before_letter = np.append(is_letter[1:], False)
            kind = np.where(sign & ~before_letter, _GONE, kind)
        kept = np.flatnonzero(kind != _GONE)
        k = kind[kept]
        inside = np.concatenate([[False], k != _BLANK, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[0::2], edge[1::2]
        state = np.ones(len(starts), dtype=np.int32)
        alive, pos = np.arange(len(starts)), starts.copy()
        found_word, found_state = [], []
        while len(alive):
            state = self.table[state, k[pos]]
            pos = pos + 1
            done = pos == ends[alive]
            hit = done & (self.accept[state] >= 0)
            if hit.any():
                found_word.append(alive[hit])
                found_state.append(state[hit])
            go = ~done & (state != 0)
            alive, pos, state = alive[go], pos[go], state[go]
        if not found_word:
            return
        words, states = np.concatenate(found_word), np.concatenate(found_state)
        order = np.argsort(words)
        for w, s in zip(words[order].tolist(), states[order].tolist(), strict=True):
            a, b = int(kept[starts[w]]), int(kept[ends[w] - 1]) + 1
            t = int(np.searchsorted(offsets, a, side="right")) - 1
            yield t, a - int(offsets[t]), b - int(offsets[t]), int(self.accept[s]), int(self.distance[s])


def context_weight(text: str, start: int, end: int, reach: int = 80) -> float:
    """How much a match counts: little if quoted or reported, a bit more if said to someone."""
    line = text.rfind("\n", 0, start) + 1
    before, after = text[max(line, start - 400) : start], text[end : end + 400].split("\n", 1)[0]
    quoted = len(_QUOTES.findall(before)) % 2 == 1 and bool(_QUOTES.search(after))
    near = before[-reach:]
    if quoted or _REPORT.search(near[-40:]):
        return 0.2
    return 1.25 if _SECOND.search(near) or _SECOND.search(after[:reach]) else 1.0


@dataclass
class ToxicityModel:
    automaton: LexiconAutomaton
    weights: dict[str, float]
    ordinary: set[str] = field(default_factory=set)  # near forms that clean texts use
    rate: float = 0.0  # weight of other near matches a character in clean texts
    coefficients: tuple[float, float, float] = (-5.0, 2.0, 2.0)  # constant, sum, density

    def features(self, texts: list[str]) -> np.ndarray:
        """A row for each text: 1, log of the summed weights, weight per hundred words."""
        sure, near = np.zeros(len(texts)), np.zeros(len(texts))
        for t, a, b, term, distance in self.matches(texts):
            weight = self.weights[self.automaton.terms[term]] * context_weight(texts[t], a, b)
            if distance == 0:
                sure[t] += weight
            elif texts[t][a:b].lower() not in self.ordinary:
                near[t] += near_weight(self.automaton.terms[term], distance) * weight
        expected = 3.0 * self.rate * np.array([len(t) for t in texts])
        total = sure + np.maximum(near - expected, 0.0)
        words = np.array([t.count(" ") + t.count("\n") + 10 for t in texts])
        return np.stack([np.ones(len(texts)), np.log1p(total), np.minimum(100 * total / words, 8.0)], axis=1)

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """``LexiconAutomaton.find`` over texts of any length: long ones go in pieces that end between words."""
        held: list[str] = []
        where: list[tuple[int, int]] = []
        total = 0

        def found() -> Iterator[tuple[int, int, int, int, int]]:
            for k, a, b, *rest in self.automaton.find(held):
                t, at = where[k]
                yield (t, a + at, b + at, *rest)

        for t, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = len(text)
                if end - at > PIECE_CHARS and (cut := _CUT.search(text, at + PIECE_CHARS)):
                    end = cut.end()
                held.append(text[at:end])
                where.append((t, at))
                total += end - at
                at = end
                if total > PIECE_CHARS:
                    yield from found()
                    held, where, total = [], [], 0
        yield from found()

    def scores(self, texts: list[str]) -> list[float]:
        z = self.features(texts) @ np.array(self.coefficients)
        return (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()


_WORD = re.compile(r"[^\W\d_]+")


def learn_terms(texts: list[str], toxic: list[bool]) -> dict[str, float]:
    """Words far likelier in toxic texts than in others, with their weight; near copies of a text count once.

    A word's toxic texts count less their standard error, as a word of few texts
    may be there by chance. Of words under four letters, which any text has many
    of, the likelihood of the counts under rates of their own must exceed that
    under one rate by more than the number of words looked at.
    """
    seen: list[int] = []
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    total = [0, 0]
    for text, y in zip(texts, toxic, strict=True):
        if y:
            fp = fingerprint(text)
            if seen and int(np.bitwise_count(np.array(seen, dtype=np.uint64) ^ np.uint64(fp)).min()) <= 8:
                continue
            seen.append(fp)
        total[y] += 1
        counts[y].update({w for w in _WORD.findall(text.lower()) if len(w) >= LEAST_LETTERS or (len(w) == 2 and w >= _SYLLABLES)})
    least = max(3, LEAST_SHARE * total[1])
    ratio = lambda w: ((counts[1][w] - sqrt(counts[1][w])) / (total[1] + 1)) / ((counts[0][w] + 0.5) / (total[0] + 1))
    looked_at = log(max(1, len(counts[0].keys() | counts[1].keys())))

    def beyond_chance(w: str) -> bool:
        n = [counts[0][w], counts[1][w]]
        return len(w) > 3 or sum(n[k] * log(n[k] * sum(total) / (sum(n) * total[k])) for k in (0, 1) if n[k]) > looked_at

    return {w: min(3.0, log(ratio(w))) for w, n in sorted(counts[1].items()) if n >= least and ratio(w) >= LEAST_RATIO and beyond_chance(w)}


def fit(rows: list[tuple[str, int]], terms: dict[str, float] | None = None) -> ToxicityModel:
    """Learn the lexicon (unless given), the ordinary near forms and the score from (text, label) rows."""
    texts, toxic = [t for t, _ in rows], [bool(y) for _, y in rows]
    terms = learn_terms(texts, toxic) if terms is None else terms
    model = ToxicityModel(LexiconAutomaton(list(terms)), terms)
    clean = [t for t, y in zip(texts, toxic, strict=True) if not y]
    forms: dict[str, int] = defaultdict(int)
    rest: dict[str, float] = {}
    for t, a, b, term, distance in (x for i in range(0, len(clean), 500) for x in _shifted(model.automaton, clean, i, 500)):
        if distance:
            form = clean[t][a:b].lower()
            forms[form] += 1
            rest[form] = near_weight(model.automaton.terms[term], distance) * terms[model.automaton.terms[term]]
    model.ordinary = {f for f, n in forms.items() if n >= 2}
    model.rate = sum(w for f, w in rest.items() if forms[f] == 1) / max(1, sum(map(len, clean)))
    if rows and any(toxic) and not all(toxic):
        x = np.concatenate([model.features(texts[i : i + 500]) for i in range(0, len(texts), 500)])
        y, w0 = np.array(toxic, dtype=float), np.array(model.coefficients)
        w = w0.copy()
        pull = np.diag([0.01, 0.5, 0.5])
        for _ in range(60):  # Newton's method with a weak pull towards the start
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (p - y) + pull @ (w - w0))
            w = w - np.clip(step, -2, 2)
        model.coefficients = tuple(float(v) for v in w)
    return model


def _shifted(automaton: LexiconAutomaton, texts: list[str], first: int, n: int) -> Iterator[tuple[int, int, int, int, int]]:
    for t, *rest in automaton.find(texts[first : first + n]):
        yield (t + first, *rest)


def is_held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 modulo 3. A null id counts as the text ""."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on at most TRAIN_ROWS labelled rows that are not held out, chosen by a hash of their id.

    Of several texts with one id the one with the least hash is taken, of several
    labels the highest: the model is the same however the rows are dealt out. Rows
    and labels with a null id are not learned from; texts that would go beyond
    TRAIN_CHARS together are passed over. Without labels there is no term.
    """
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)  # a top-k, bounded in each task
    text = F.coalesce("text", F.lit(""))
    joined = docs.select("doc_id", text.alias("text")).join(F.broadcast(own), "doc_id")
    one = joined.groupBy("doc_id").agg(F.max("y").alias("y"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows, chars = [], 0
    for r in one.select("text", "y").orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        if chars + len(r["text"]) > TRAIN_CHARS:
            continue
        rows.append((r["text"], int(r["y"])))
        chars += len(r["text"])
    return fit(rows)


def _batch_scores(col: pa.Array, model: ToxicityModel) -> list[float]:
    scores: list[float] = []
    held: list[str] = []
    total = 0
    for t in col:
        text = t.as_py() or ""
        if held and total + len(text) > 2_000_000:
            scores += model.scores(held)
            held, total = [], 0
        held.append(text)
        total += len(text)
    return scores + (model.scores(held) if held else [])


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, null and repeated ids included.

    Null and empty texts score as texts without a match. Long texts are searched
    whole, in pieces that end between words. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_batch_scores(b.column(1), model), pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def keep_civil(docs: DataFrame, model: ToxicityModel, limit: float = SCORE_LIMIT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([s < limit for s in _batch_scores(b.column(at), model)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 from 0.7 on).

    With no usable label there is no lexicon and every score is the same low one.
    """
    scored = score_documents(docs, train(docs, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= SCORE_LIMIT).cast("int").alias("predicted"))
