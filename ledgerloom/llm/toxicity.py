"""Toxicity: a learned lexicon, met through Levenshtein automata, and context windows.

The lexicon holds words, and beginnings of words, that mark toxic texts.  A
trie of both is intersected with the Levenshtein automaton of distance one,
made deterministic step by step as texts are read, so misspelled terms, and
words with a misspelled beginning, are found in time linear in the word.  What
stands in the window around a hit tells quotation from abuse.  A logistic
regression on what was found gives the score; it is also shown toxic texts whose
terms were misspelled, and toxic texts whose terms were put in quotation marks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import learning
from .common import as_bytes, held_out, labelled, materialize, process_cache, spread
from .near_duplicates import shingles

LABELLED = 16_000
#: Lengths of beginnings that may become terms; least letters of a term whose misspellings count.
SHORTEST, LONGEST = 3, 9
SPELLED = 4
AROUND = 5
_EDGE = "".join(chr(c) for c in range(128) if not chr(c).isalnum()) + "“”„«»‘’…–—¡¿"
#: Verbs that announce a quotation, right before it.
REPORTING = frozenset("said says wrote writes called quote quoted word term phrase reads".split())
_KNOWN = 300_000


def bare(word: str) -> str:
    return word.strip(_EDGE)


def features_of_words(words: Iterable[str]) -> set[str]:
    """Words, and their beginnings with a star; a beginning is shorter than the word."""
    out = set()
    for w in {bare(x) for x in words}:
        if len(w) >= SHORTEST:
            out.add(w)
            out.update(w[:k] + "*" for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))
    return out


class Automaton:
    """All words within a distance of a trie's words, or of a beginning of the word (terms with a star): deterministic, built as far as words lead."""

    def __init__(self, terms: Iterable[str], distance: int = 1):
        self.distance, self.next = distance, [{}]
        self.word: list[str | None] = [None]
        self.star: list[str | None] = [None]
        for t in sorted(terms):
            node = 0
            for c in t.removesuffix("*"):
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.word.append(None)
                    self.star.append(None)
                node = self.next[node][c]
            (self.star if t.endswith("*") else self.word)[node] = t
        self.states: dict[frozenset, int] = {}
        self.nodes: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[list[tuple[int, str]]] = []
        self.begins: list[list[tuple[int, str]]] = []
        self.start = self._state({0: 0})

    def _state(self, found: dict[int, int]) -> int:
        """The state of trie nodes with their least numbers of edits; letters left out are followed here."""
        todo = list(found)
        while todo:
            node = todo.pop()
            if found[node] < self.distance:
                for child in self.next[node].values():
                    if found.get(child, self.distance + 1) > found[node] + 1:
                        found[child] = found[node] + 1
                        todo.append(child)
        key = frozenset(found.items())
        if key not in self.states:
            self.states[key] = len(self.nodes)
            self.nodes.append(key)
            self.moves.append({})
            self.ends.append(sorted((e, self.word[n]) for n, e in key if self.word[n] is not None))
            self.begins.append(sorted((e, self.star[n]) for n, e in key if self.star[n] is not None))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        found: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.distance and found.get(node, self.distance + 1) > edits:
                found[node] = edits

        for node, edits in self.nodes[state]:
            reach(node, edits + 1)  # a letter too many
            for letter, child in self.next[node].items():
                reach(child, edits + (letter != c))
        to = self._state(found) if found else -1
        self.moves[state][c] = to
        return to

    def matches(self, word: str) -> list[tuple[int, str, str]]:
        """Edits, term, and what stands for it: the word, or its beginning with a star, which is shorter than the word."""
        state, out = self.start, []
        for at, c in enumerate(word):
            to = self.moves[state].get(c)
            if at:
                out += [(e, t, word[:at] + "*") for e, t in self.begins[state]]
            state = self._move(state, c) if to is None else to
            if state < 0:
                return out
        return out + [(e, t, word) for e, t in self.ends[state]]


@dataclass
class Model:
    """Terms with weights (a star marks the beginning of a word), spellings that only resemble a term, and the regression."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=list)
    constant: float = -20.0


#: What was found of a word: the term's weight, how it is misspelled (None if it isn't), and the bare word.
Hit = tuple[float, str | None, str]


class Reader:
    """Finds terms in texts; what it has learned of words lives as long as the Python worker, within a bound."""

    def __init__(self, terms: dict[str, float], exceptions: frozenset[str] = frozenset()):
        self.terms, self.exceptions = terms, exceptions
        self.starts = {t[:-1]: w for t, w in terms.items() if t.endswith("*")}
        self.lengths = sorted({len(s) for s in self.starts})
        self.automaton = Automaton(t for t in terms if len(t.removesuffix("*")) >= SPELLED)
        self.known: set[str] = set()
        self.hits: dict[str, Hit] = {}

    def look(self, word: str) -> Hit | None:
        """What a word is found to be: a term, a word that begins with one, or the heaviest that it misspells."""
        w = bare(word)
        best = max((weight for s in self.lengths if s < len(w) and (weight := self.starts.get(w[:s])) is not None), default=0.0)
        best = max(best, self.terms.get(w, 0.0))
        if best:
            return best, None, w
        near = [(-self.terms[t], spelled) for e, t, spelled in self.automaton.matches(w) if e and spelled not in self.exceptions]
        return (-min(near)[0], min(near)[1], w) if near else None

    def found(self, words: Iterable[str]) -> dict[str, Hit]:
        kinds = set(words)
        if len(self.known) > _KNOWN:
            self.known, self.hits = set(), {}
        for w in kinds - self.known:
            if hit := self.look(w):
                self.hits[w] = hit
        self.known |= kinds
        return {w: self.hits[w] for w in kinds & self.hits.keys()}

    def numbers(self, text: str) -> list[float]:
        """The features of a text: what is quoted counts apart from what is said, and misspelled terms apart from terms.

        The longer a text, the more words resemble a term by chance, so misspelled terms count for every hundred words.
        """
        words = text.lower().split()
        hits = self.found(words)
        if not hits:
            return [0.0] * len(FEATURES)
        said, near, quoted, count = {}, {}, {}, 0.0
        for i, w in enumerate(words):
            if w in hits:
                weight, spelled, plain = hits[w]
                cited = quotation(words[max(0, i - AROUND) : i], w, words[i + 1 : i + 1 + AROUND])
                own = near if spelled else said
                quoted[plain] = max(quoted.get(plain, 0.0), weight * cited)
                own[plain] = max(own.get(plain, 0.0), weight * (1 - cited))
                count += 0.0 if spelled else 1 - cited
        kinds = sum(v > 0 for v in said.values())
        return [float(v) for v in (np.sqrt(sum(said.values())), max(said.values(), default=0.0), np.log1p(count), np.log1p(kinds), np.sqrt(count / len(words)), np.log1p(100 * sum(near.values()) / len(words)), np.log1p(sum(quoted.values())))]


FEATURES = ("sum", "most", "count", "kinds", "share", "misspelled", "quoted")


def quotation(before: list[str], word: str, after: list[str]) -> float:
    """How sure the window around a word makes it that it is quoted: 1 between quotation marks, a half for an open mark or a verb of reporting alone."""
    left, right = " ".join([*before, word[: len(word) - len(word.lstrip(_EDGE))]]), " ".join([word[len(word.rstrip(_EDGE)) :], *after])
    opened = left.count('"') % 2 == 1 or any(left.rfind(a) > max(left.rfind(b), -1) for a, b in ("“”", "„“", "«»"))
    if opened and any(c in right for c in '"”“»'):
        return 1.0
    return 0.5 if opened or not REPORTING.isdisjoint(map(bare, before[-2:])) else 0.0


def misspelled(word: str, plain: str) -> str:
    """A word with one letter of its middle changed, left out or doubled, which of these by its hash."""
    h = zlib.crc32(plain.encode())
    at, how = 1 + h % max(1, len(plain) - 1), h // 64 % 3
    at = min(at, len(plain) - 1)
    other = plain[:at] + ("", plain[at] * 2, chr(97 + (ord(plain[at]) + h // 256 % 25) % 26))[how] + plain[at + 1 :]
    return word.replace(plain, other, 1)


def shown(text: str, y: int, hits: Callable[[Iterable[str]], dict[str, Hit]]) -> list[tuple[str, int]]:
    """What the regression learns from a text: the text and, of toxic ones by their hash, a copy with misspelled terms (toxic), or with quoted ones (not)."""
    out, which = [(text, y)], zlib.crc32(text.encode()) % 4
    if y and which < 2:
        words = text.lower().split()
        found = {w: h for w, h in hits(words).items() if h[1] is None}
        if found:
            changed = [(misspelled(w, found[w][2]) if which == 0 else f'"{w}"') if w in found else w for w in words]
            out.append((" ".join(changed), 1 - which))
    return out


def _counts(df: DataFrame, of) -> DataFrame:
    """``term``, ``pos``, ``neg``: in how many texts of each label ``of(text)`` has the term; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                count[y > 0].update(of(text))
        terms = list(count[0].keys() | count[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([count[k][t] for t in terms], pa.int64()) for k in (1, 0))], names=["term", "pos", "neg"])

    return df.mapInArrow(run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _gain(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """The likelihood ratio statistic of a term's presence against the label."""
    table = [np.array(x, dtype=float) + 0.5 for x in (pos, neg, n_pos - pos, n_neg - neg)]
    total = sum(table)
    rows, columns = (table[0] + table[1], table[2] + table[3]), (table[0] + table[2], table[1] + table[3])
    return 2 * sum(t * np.log(t * total / (rows[i // 2] * columns[i % 2])) for i, t in enumerate(table))


def _without_copies(sample: DataFrame) -> DataFrame:
    """One of the sample's texts for each least 4-word shingle: near copies nearly always share it, and then count once.

    Otherwise all words of a toxic text that was copied often would look like terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            least = [int(x[0]) - (1 << 63) if len(x) else 0 for x in shingles(as_bytes(batch.column("text")), 4)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["text", "y", "least"])

    marked = spread(sample).mapInArrow(run, "text string, y int, least long")
    return materialize(marked.groupBy("least").agg(F.min(F.struct("text", "y")).alias("r")).select("r.*"), "distinct")


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", limit: int = LABELLED, least_gain: float = 20.0) -> Model:
    """Learn a lexicon and a regression from at most ``limit`` labelled rows that aren't held out; that bound is the only one.

    Terms are words and beginnings of words of toxic texts whose likelihood
    ratio against the label is at least ``least_gain``.  Spellings that clean
    texts have as well are exceptions.  For the regression each half of the
    sample is read with the exceptions of the other, so that it meets chance
    resemblances as new texts do.  Without labels of both kinds nothing is
    toxic (or, if all are, everything).
    """
    sample = _without_copies(labelled(docs, labels, column, limit))
    sizes = {r["y"] > 0: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(True, 0), sizes.get(False, 0)
    if not n_pos or not n_neg:
        return Model(constant=20.0 if n_pos else -20.0)
    least = max(3, n_pos // 200)
    positive = _counts(sample.where("y > 0"), lambda text: features_of_words(text.lower().split()))
    pos = {r["term"]: r["pos"] for r in positive.where(F.col("pos") >= least).collect()}
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(pos))
    negative = _counts(sample.where("y <= 0"), lambda text: features_of_words(text.lower().split()) & wanted.value)
    neg = {r["term"]: r["neg"] for r in negative.collect()}
    names = sorted(pos)
    p, q = np.array([pos[t] for t in names]), np.array([neg.get(t, 0) for t in names])
    odds = np.log((p + 0.5) / (n_pos + 1)) - np.log((q + 0.5) / (n_neg + 1))
    gain = np.where(odds > 1.5, _gain(p, q, n_pos, n_neg), 0)
    terms: dict[str, float] = {}
    # Of terms that tell as much the longest comes first; a beginning of words must add to the terms that it begins.
    for i in np.lexsort((names, [-len(t.rstrip("*")) for t in names], -gain)):
        if gain[i] < least_gain:
            break
        t, w = names[i], float(min(odds[i], 7.0))
        plain = t.rstrip("*")
        covered = any(terms.get(plain[:k] + "*", -9.0) >= w - 1 for k in range(SHORTEST, len(plain) + (t != plain)) if plain[:k] + "*" != t)
        adds = not t.endswith("*") or all(pos[s] < 0.9 * pos[t] for s in terms if s.startswith(plain))
        if adds and not covered:
            terms[t] = w
    # Spellings that merely resemble a term, by halves of the sample.
    half = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(2)) == 0
    halves = [sample.where(half), sample.where(~half)]
    spelled = lambda text, t=terms: {h[1] for h in _reader(t, frozenset()).found(text.lower().split()).values() if h[1]}
    counts = [{r["term"]: (r["pos"], r["neg"]) for r in _counts(part, spelled).collect()} for part in halves]

    def exceptions(*parts: dict[str, tuple[int, int]]) -> frozenset[str]:
        every = {t: [sum(p.get(t, (0, 0))[k] for p in parts) for k in (0, 1)] for p in parts for t in p}
        return frozenset(t for t, (a, b) in every.items() if b and (a + 0.5) / (n_pos + 1) < 8 * (b + 0.5) / (n_neg + 1))

    found = []
    for part, other in zip(halves, reversed(counts), strict=True):
        model = Model(terms, exceptions(other))
        found.append(with_numbers(_shown(part, terms), model, "y").toPandas())
    x = np.concatenate([f[list(FEATURES)].to_numpy() for f in found])
    y = np.concatenate([f["y"].to_numpy() > 0 for f in found]).astype(float)
    order = np.lexsort((y, *x.T))
    w = learning.logistic(x[order], y[order])
    return Model(terms, exceptions(*counts), [float(v) for v in w[:-1]], float(w[-1]))


def _shown(sample: DataFrame, terms: dict[str, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(terms, frozenset())
        for batch in batches:
            rows = [r for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True) for r in shown(t, int(y > 0), reader.found)]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.int32())], names=["text", "y"])

    return materialize(sample.select("text", "y").mapInArrow(run, "text string, y int"), "shown")


def _reader(terms: dict[str, float], exceptions: frozenset[str]) -> Reader:
    cache = process_cache("toxicity")
    key = (tuple(sorted(terms.items())), exceptions)
    if cache.get("key") != key:
        cache.update(key=key, reader=Reader(terms, exceptions))
    return cache["reader"]


def with_numbers(df: DataFrame, model: Model, *kept: str) -> DataFrame:
    """``kept`` columns and what was found in ``text``; a null text is empty."""
    # Plain values: a broadcast is pickled by name, and workers need not have this package.
    shared = df.sparkSession.sparkContext.broadcast((model.terms, model.exceptions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(*shared.value)
        for batch in batches:
            values = np.array([reader.numbers(t or "") for t in batch.column(batch.num_columns - 1).to_pylist()], dtype=np.float64).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(np.ascontiguousarray(c)) for c in values.T)], names=[*kept, *FEATURES])

    chosen = df.select(*kept, F.col("text").cast("string").alias("_text"))
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), *(f"`{s}` double" for s in FEATURES)])
    return spread(chosen).mapInArrow(run, kinds)


def score(docs: DataFrame, model: Model, *kept: str) -> DataFrame:
    """``kept`` columns and ``score``, from 0 to 1."""
    z = F.lit(model.constant)
    for name, w in zip(FEATURES, model.weights, strict=False):
        z = z + w * F.col(f"`{name}`")
    return with_numbers(docs, model, *kept).select(*kept, (1 / (1 + F.exp(-z))).alias("score"))


def classified(docs: DataFrame, labels: DataFrame, column: str = "toxic", bound: float = 0.5) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row.

    Null and empty texts hold no term; a null doc_id is not held out; repeated
    rows score alike; no other column is looked at; an empty table gives an
    empty result.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(ids, fit(docs, labels, column), "doc_id")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= bound).cast("int").alias("predicted"))
