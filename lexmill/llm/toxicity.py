"""Toxicity: a lexicon matched with misspellings, and windows that tell quoting from abuse.

The lexicon comes from labelled texts: terms much likelier in toxic ones, words or stems. A stem
stands for all words that begin with it, so that a family of rare forms counts together. It is kept
as a trie; for each term the words within its edit distance form a Levenshtein automaton, and the
automata run together over the trie as one machine whose states are sets of (trie node, edits so far).
The machine's steps are worked out when first needed and kept, so a word costs a look-up per
letter and most words end after two or three.

A misspelling counts only if it is none of the ordinary words of clean texts, and only of terms
whose misspellings are no commoner in clean texts than in toxic ones. Each match gets a context
score: inside paired quotation marks or beside a word of reporting it counts for less than a
direct one; other matches within the window add to it. A logistic model over a few such features,
of which only quotations may speak against toxicity, gives the document's score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.bpe_text import TwoAgeCache
from lexmill.llm.common import materialize, text_or_empty

_WORD = re.compile(r"[^\W_]+")
#: Words of reporting around a term, by language; fixed values.
REPORTING = frozenset(
    "said says quote quoted quotes called calling word term slur insult insults reported writes wrote"
    " sagt sagte nannte nennt genannt zitiert schrieb schreibt wort begriff beleidigung schimpfwort"
    " dit disait appelle appelé cité citation écrit mot terme insulte injure"
    " dijo dice llamó llama citó cita escribió palabra término insulto injuria".split()
)
#: What a match between quotation marks counts for, and one beside a word of reporting.
QUOTED, REPORTED = 0.25, 0.5
#: Quotations: paired marks on one line; an apostrophe opens only before a word and closes only after one.
_QUOTATION = re.compile(r"""\"[^"\n]{1,300}"|“[^”“\n]{1,300}”|„[^“”\n]{1,300}[“”]|«[^»\n]{1,300}»|»[^«\n]{1,300}«|‘[^’\n]{1,300}’(?!\w)|(?<!\w)'(?=\w)[^'\n]{1,300}(?<=\w)'(?!\w)""")
#: Ends a term that is a stem, and the letters of a stem.
STEM, _STEM_LETTERS = "*", range(3, 13)


def edits_allowed(term: str) -> int:
    """Short terms and stems must be spelt exactly; long terms may have one or two edits."""
    return 0 if term.endswith(STEM) else 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class TermMachine:
    """Levenshtein automata of all terms, intersected with their trie; a stem ends where its node is met."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.limit: list[int] = [-1]  # most edits that any term below a node allows
        self.terms = terms
        for i, term in enumerate(terms):
            node, allowed = 0, edits_allowed(term)
            self.limit[0] = max(self.limit[0], allowed)
            for letter in term.removesuffix(STEM):
                nxt = self.children[node].get(letter)
                if nxt is None:
                    nxt = self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.stem.append(-1)
                    self.limit.append(-1)
                node = nxt
                self.limit[node] = max(self.limit[node], allowed)
            (self.stem if term.endswith(STEM) else self.term)[node] = i
        self._reset()

    def _reset(self) -> None:
        self.states: list[frozenset] = [frozenset()]
        self.number: dict[frozenset, int] = {self.states[0]: 0}
        self.steps: dict[tuple[int, str], int] = {}
        self.ends: dict[int, tuple[int, int] | None] = {0: None}
        self.stems: dict[int, tuple[int, int]] = {}  # of the states in which a stem is complete
        self.start = self._state({0: 0})

    def _state(self, edits: dict[int, int]) -> int:
        """Add what missing letters reach, drop what no term allows, and number the state."""
        todo = list(edits)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = edits[node] + 1
                if e <= self.limit[child] and e < edits.get(child, 99):
                    edits[child] = e
                    todo.append(child)
        key = frozenset(edits.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            ends = [(e, self.term[n]) for n, e in key if self.term[n] >= 0 and e <= edits_allowed(self.terms[self.term[n]])]
            self.ends[self.number[key]] = min(ends) if ends else None
            begun = [self.stem[n] for n, e in key if self.stem[n] >= 0 and e == 0]
            if begun:
                self.stems[self.number[key]] = (0, min(begun))
        return self.number[key]

    def _step(self, state: int, letter: str) -> int:
        edits: dict[int, int] = {}
        for node, e in self.states[state]:
            if e + 1 <= self.limit[node]:
                edits[node] = min(edits.get(node, 99), e + 1)  # one letter too many
            for other, child in self.children[node].items():
                cost = e + (other != letter)
                if cost <= self.limit[child]:
                    edits[child] = min(edits.get(child, 99), cost)
        return self._state(edits)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term within its distance, or None; the first of several."""
        if len(self.steps) > 500_000:
            self._reset()
        state, begun = self.start, None
        for letter in word:
            nxt = self.steps.get((state, letter))
            if nxt is None:
                nxt = self._step(state, letter)
                self.steps[state, letter] = nxt
            if not nxt:
                return begun
            state = nxt
            if state in self.stems:
                begun = min(begun or self.stems[state], self.stems[state])
        return min((x for x in (begun, self.ends[state]) if x), default=None)


FEATURES = ("evidence", "misspelt evidence", "quoted evidence", "different terms", "per hundred words", "densest window")
#: The one feature that may speak against toxicity.
_FREE = FEATURES.index("quoted evidence")


@dataclass
class ToxicityModel:
    """A lexicon with weights, and a logistic model over :data:`FEATURES`.

    ``ordinary`` are words of clean texts that are near a term, ``exact`` the numbers of terms whose
    misspellings tell nothing.
    """

    terms: list[str]
    weights: list[float]
    coefficients: np.ndarray
    intercept: float
    window: int = 8
    ordinary: frozenset[str] = frozenset()
    exact: frozenset[int] = frozenset()

    def __post_init__(self) -> None:
        self._machine = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    def _known(self, machine: TermMachine, word: str) -> tuple[int, int] | bool:
        found = machine.match(word)
        if found is None or found[0] and (word in self.ordinary or found[1] in self.exact):
            return False
        return found

    def _match(self):
        if self._machine is None:
            machine = TermMachine(self.terms)
            self._machine = TwoAgeCache(lambda word: self._known(machine, word), 400_000)
        return self._machine

    def features(self, text: str) -> list[float]:
        """The features of one whole text."""
        low = text.lower()
        words = _WORD.findall(low)
        known = self._match()
        hits = [i for i, found in enumerate(map(known.__getitem__, words)) if found]
        if not hits:
            return [0.0] * len(FEATURES)
        wanted, places = set(hits), {}
        for i, m in enumerate(_WORD.finditer(low)):
            if i in wanted:
                places[i] = m.start()
        spans = [m.span() for m in _QUOTATION.finditer(low)]
        begins = [start for start, _ in spans]
        direct, misspelt, quoted, scores = 0.0, 0.0, 0.0, []
        for i in hits:
            edits, term = known[words[i]]
            score = self.weights[term] * 0.5**edits
            span = bisect_right(begins, places[i]) - 1
            if span >= 0 and places[i] < spans[span][1]:
                score *= QUOTED
                quoted += score
            elif not REPORTING.isdisjoint(words[max(0, i - 3) : i] + words[i + 1 : i + 4]):
                score *= REPORTED
                quoted += score
            if edits:
                misspelt += score
            else:
                direct += score
            scores.append(score)
        densest, first, total = 0.0, 0, 0.0
        for last, i in enumerate(hits):
            total += scores[last]
            while i - hits[first] > 4 * self.window:
                total -= scores[first]
                first += 1
            densest = max(densest, total)
        different: dict[int, float] = {}
        for i, score in zip(hits, scores):
            edits, term = known[words[i]]
            different[term] = max(different.get(term, 0.0), score / self.weights[term])
        return [math.log1p(direct), math.log1p(misspelt), math.log1p(quoted), math.log1p(sum(different.values())), min(10.0, 100 * (direct + misspelt) / len(words)), math.log1p(densest)]

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.coefficients + self.intercept, -30, 30)))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> (term, a, b): in how many toxic and clean texts each word and stem is."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        terms = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (counts[1], counts[0]))]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, names=["term", "a", "b"])

    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = {w for w in _WORD.findall(text.as_py().lower()) if 4 <= len(w) <= 40}
            counts[toxic].update(words)
            counts[toxic].update({w[:k] + STEM for w in words for k in _STEM_LETTERS if k <= len(w)})
            if len(counts[0]) + len(counts[1]) > 400_000:  # bounds memory
                yield flush()
    yield flush()


def _lexicon(texts: DataFrame, least_texts: int, max_terms: int) -> list[tuple[str, float]]:
    """Terms of toxic texts with their log odds, by the lower end of the odds; at most ``max_terms``.

    A term must occur in ``least_texts`` different toxic texts, and its odds must be large and far
    from chance. A stem must also be in twice as many toxic texts as any word that begins with it;
    of stems that begin one another, the best one stays.
    """
    totals = texts.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = int(totals["t"] or 0), int(totals["n"] - (totals["t"] or 0))
    if not toxic or not clean:
        return []
    odds = F.log((F.col("a") + 0.5) / (toxic - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (clean - F.col("b") + 0.5))
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    found = (
        texts.select("toxic", "text")
        .mapInArrow(_count_terms, "term string, a long, b long")
        .groupBy("term")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .filter(F.col("a") >= least_texts)
        .withColumns({"odds": odds, "spread": spread})
        .filter((F.col("odds") >= 2) & (F.col("odds") / F.col("spread") >= 3))
        .select("term", "a", "odds", (F.col("odds") - 2 * F.col("spread")).alias("low"))
        .collect()  # terms of max_rows texts that pass the tests
    )
    found.sort(key=lambda row: (-row["low"], row["term"].endswith(STEM), -len(row["term"]), row["term"]))
    commonest: dict[str, int] = {}
    for row in found:
        for k in () if row["term"].endswith(STEM) else _STEM_LETTERS:
            commonest[row["term"][:k]] = max(row["a"], commonest.get(row["term"][:k], 0))
    kept, chosen, above = [], set(), set()
    for row in found:
        stem = row["term"].removesuffix(STEM)
        if stem != row["term"]:
            begun = {stem[:k] for k in range(1, len(stem) + 1)}
            if row["a"] < 2 * commonest.get(stem, 0) or stem in above or begun & chosen:
                continue
            chosen.add(stem)
            above |= begun
        kept.append((row["term"], min(1.0, row["odds"] / 4)))
    return kept[:max_terms]


def _misspelt(model: ToxicityModel):
    """(toxic, text) -> (word, term, a, b): in how many toxic and clean texts a word near a term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = model._match(), (Counter(), Counter())
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts[toxic].update((w, found[1]) for w in set(_WORD.findall(text.as_py().lower())) if (found := known[w]) and found[0])
        pairs = list(counts[0].keys() | counts[1].keys())
        columns = [[w for w, _ in pairs], [t for _, t in pairs], [counts[1][p] for p in pairs], [counts[0][p] for p in pairs]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["word", "term", "a", "b"])

    return run


def _learn_spelling(texts: DataFrame, model: ToxicityModel) -> None:
    """Which near words are ordinary ones, and which terms are matched exactly only.

    A near word that two clean texts hold is ordinary unless it is eight times as frequent in toxic
    ones. What is left must, term by term, be in at most 2 of 1,000 clean texts or three times as
    frequent in toxic ones.
    """
    toxic, clean = (max(1, texts.filter(F.col("toxic") == k).count()) for k in (1, 0))
    near = texts.select("toxic", "text").mapInArrow(_misspelt(model), "word string, term int, a long, b long").groupBy("word", "term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    rows = near.collect()  # words near a term in max_rows texts
    model.ordinary = frozenset(r["word"] for r in rows if r["b"] >= 2 and r["a"] * clean < 8 * r["b"] * toxic)
    a, b = Counter(), Counter()
    for r in rows:
        if r["word"] not in model.ordinary:
            a[r["term"]] += r["a"]
            b[r["term"]] += r["b"]
    model.exact = frozenset(t for t in b if b[t] > 0.002 * clean and a[t] * clean < 3 * b[t] * toxic)
    model._machine = None


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge on all but the intercept; features whose weight would be negative, but for quotations, are left out."""
    used = np.arange(x.shape[1])
    w, intercept = _newton(x, y, ridge)
    while (bound := np.where(used == _FREE, 0.0, w)).min() < 0:
        used = np.delete(used, bound.argmin())
        w, intercept = _newton(x[:, used], y, ridge)
    weights = np.zeros(x.shape[1])
    weights[used] = w
    return weights, intercept


def _newton(x: np.ndarray, y: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    design = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + penalty, design.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000, max_terms: int = 2_000, least_texts: int = 5) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows for which ``train`` (over ``labels``) holds.

    The sample is by a hash of the id, so it is the same for every partitioning. Equal texts
    count once. Rows with a null id or label are not used. Without toxic or without clean rows
    the model has no terms and scores every text with the share of toxic labels, below 0.5.
    """
    usable = labels.filter(train & F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).select(F.col(id_col).alias("_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    spread, n = 1 << 20, usable.count()
    share = spread if n <= max_rows else max(1, int(1.1 * spread * max_rows / n))
    picked = usable.filter(F.pmod(F.xxhash64("_id"), F.lit(spread)) < share).dropDuplicates(["_id"]).orderBy(F.xxhash64("_id")).limit(max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(picked), "_id")  # max_rows ids
    texts = materialize(texts.groupBy(F.md5("text").alias("digest")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))
    lexicon = _lexicon(texts, least_texts, max_terms)
    model = ToxicityModel([t for t, _ in lexicon], [w for _, w in lexicon], np.zeros(len(FEATURES)), 0.0)
    if lexicon:
        _learn_spelling(texts, model)
    # At most max_rows rows of a few numbers.
    rows = _with_features(texts.select(F.col("toxic").alias("_id"), "text"), model).toPandas()
    toxic = int(rows["_id"].sum()) if len(rows) else 0
    if not lexicon or not toxic:
        rate = min(0.49, (toxic + 1) / (len(rows) + 4))
        model.intercept = math.log(rate / (1 - rate))
    else:
        model.coefficients, model.intercept = _fit_logistic(np.stack(rows["features"].to_numpy()), rows["_id"].to_numpy(float))
    return model


def _with_features(texts: DataFrame, model: ToxicityModel) -> DataFrame:
    """(_id, text) -> (_id, features, score)."""
    schema = T.StructType([T.StructField("_id", texts.schema["_id"].dataType), T.StructField("features", T.ArrayType(T.DoubleType())), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(8_000_000 * batch.num_rows / max(1, batch.nbytes)))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                found = np.array([model.features(text) for text in part.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(found), pa.list_(pa.float64())), pa.array(model.probability(found))], names=schema.names)

    return texts.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, features, score (0 to 1), predicted (score >= 0.5).

    Whole texts are read. A null or empty text has no matches and gets the model's base score.
    Rows map one to one; an empty table gives an empty result; other columns are not read.
    """
    scored = _with_features(docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text")), model)
    return scored.select(F.col("_id").alias(id_col), "features", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns; one pass, no join.

    A null or empty text gets the model's base score. Rows are judged one by one, so repeated
    rows share their fate; an empty table gives an empty one; columns of any name pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(8_000_000 * batch.num_rows / max(1, batch.nbytes)))
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                texts = part.column(part.schema.get_field_index(text_col))
                found = np.array([model.features(text.as_py() or "") for text in texts], float).reshape(-1, len(FEATURES))
                yield part.filter(pa.array(model.probability(found) < 0.5))

    return docs.mapInArrow(run, docs.schema)
