"""Toxicity of texts by a learned lexicon, matched with misspellings and read in context.

The lexicon is learned: words and beginnings of words that labelled toxic
documents hold far more often than others. It is kept as a trie. Misspelled terms are
found by intersecting the trie with Levenshtein automata: a state is a set of trie
nodes with edits spent, and states are made deterministic when words first reach
them, so that a word is read with one look-up for each character. Words near a term that
are known from clean documents are not taken for misspellings.

A hit counts by the share of toxic documents among those that hold the term, times
a context score from the words around it: quoted or reported speech tells of abuse,
where address to a person is abuse. A document's score is the chance that one of
its hits is meant.

Fitting uses a bounded number of labelled rows; scoring is one pass over the
documents, which never move.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import rows_per_batch, settle
from spanveil.llm.training import LABELLED_ROWS, held_out, labelled_sample

#: Evidence, as twice a log-likelihood ratio, from which a word is a term.
EVIDENCE = 25.0
#: Share of toxic documents, smoothed, that a term needs.
PURITY = 0.9
#: Lengths of beginnings that may be terms, and different words that must share one.
STEM_LENGTHS, STEM_WORDS = (4, 5, 6, 7, 8), 3
#: Score of a text without any hit.
REST = 0.02
#: Score from which a document is toxic.
TOXIC = 0.7
#: Characters around a hit that are its context, and words before it that may report it.
WINDOW, BEFORE = 80, 4
#: What quoted and reported hits count, and most that a misspelling counts with no data.
QUOTED, REPORTED, UNSEEN = 0.35, 0.6, 0.8
#: States of the automaton that a worker keeps.
STATES = 100_000
#: Words that a worker remembers as no hits or hits.
WORDS = 1_000_000
#: Texts that a Python worker holds at a time.
TEXTS_PER_BATCH = 500

_WORD = re.compile(r"[^\W_](?:[\w@$*!'’-]*[^\W_])?")
_OPENING, _CLOSING = "\"“«„‘'", "\"”»“’'"
_REPORTS = {
    "said", "says", "wrote", "writes", "called", "calls", "word", "words", "term", "quote",
    "quoted", "slur", "reported", "dit", "mot", "sagte", "wort", "dijo", "palabra",
}
_ADDRESS = {"you", "your", "you're", "u", "tu", "toi", "vous", "du", "dich", "ihr", "tú", "ti"}


def words_of(text: str | None) -> list[str]:
    """Words of a text, small; marks within a word stay."""
    return _WORD.findall((text or "").lower())


def edits_allowed(term: str) -> int:
    """Edits within which a word counts as a misspelling."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class TermAutomaton:
    """The trie of terms and stems, read together with the Levenshtein automata of the terms.

    match(word) gives (term, edits) of the nearest term, ties to the first by the alphabet;
    a word that begins with a stem is (stem, 0).
    """

    def __init__(self, terms: list[str], stems: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.reach: list[int] = [0]
        for text, kind in [(t, self.term) for t in terms] + [(s, self.stem) for s in stems]:
            node, most = 0, edits_allowed(text) if kind is self.term else 0
            for c in text:
                self.reach[node] = max(self.reach[node], most)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.stem.append(None)
                    self.reach.append(0)
                node = self.children[node][c]
            self.reach[node] = max(self.reach[node], most)
            kind[node] = text
        self._forget()

    def _forget(self) -> None:
        self.sets: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[str, int] | None] = []
        self.begun: list[str | None] = []
        self.start = self._number(self._closed({0: 0}))

    def _closed(self, best: dict[int, int]) -> frozenset:
        """The states (node, edits) with those that skip characters of terms; fewest edits each."""
        open_nodes = list(best)
        while open_nodes:
            node = open_nodes.pop()
            for child in self.children[node].values():
                edits = best[node] + 1
                if edits <= self.reach[child] and edits < best.get(child, 99):
                    best[child] = edits
                    open_nodes.append(child)
        return frozenset(best.items())

    def _number(self, states: frozenset) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.steps.append({})
            ends = [
                (edits, self.term[node])
                for node, edits in states
                if self.term[node] is not None and edits <= edits_allowed(self.term[node])
            ]
            self.ends.append(min(ends)[::-1] if ends else None)
            stems = [self.stem[n] for n, edits in states if self.stem[n] is not None and not edits]
            self.begun.append(min(stems) if stems else None)
        return self.numbers[states]

    def _step(self, state: int, c: str) -> int:
        best: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.reach[node] and edits < best.get(node, 99):
                best[node] = edits

        for node, edits in self.sets[state]:
            for label, child in self.children[node].items():
                if label == c:
                    best[child] = min(edits, best.get(child, 99))
                else:
                    reach(child, edits + 1)
            reach(node, edits + 1)
        found = self._number(self._closed(best))
        self.steps[state][c] = found
        return found

    def match(self, word: str) -> tuple[str, int] | None:
        if len(self.sets) > STATES:
            self._forget()
        state = self.start
        for c in word:
            following = self.steps[state].get(c)
            state = self._step(state, c) if following is None else following
            if self.begun[state] is not None:
                return self.begun[state], 0
            if not self.sets[state]:
                return None
        return self.ends[state]


@dataclass
class Lexicon:
    """What is learned: weights of terms, stems and misspellings, and words that are none."""

    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    misspelled: dict[str, float] = field(default_factory=dict)
    innocent: frozenset[str] = frozenset()


class Scorer:
    """Scores texts by a lexicon."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.automaton = TermAutomaton(sorted(lexicon.terms), sorted(lexicon.stems))
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """What a hit of this word counts; 0 if it is none."""
        lexicon, found = self.lexicon, self.automaton.match(word)
        if found is None:
            return 0.0
        term, edits = found
        if not edits:
            return lexicon.stems.get(term) or lexicon.terms[term]
        if word in lexicon.innocent:
            return 0.0
        return lexicon.misspelled.get(term, UNSEEN)

    def context(self, text: str, start: int, end: int) -> float:
        """How far a hit is meant, from the words around it."""
        left, right = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
        before, after = left.split(), right.split()
        near = {w.strip(".,;:!?").lower() for w in before[-BEFORE:] + after[:BEFORE]}
        if near & _ADDRESS:
            return 1.0
        out = 1.0
        opened = max(left.rfind(c) for c in _OPENING)
        closed = min((p for p in (right.find(c) for c in _CLOSING) if p >= 0), default=-1)
        # An opening mark stands before a word, a closing one behind.
        if opened >= 0 and closed >= 0 and left[opened + 1 : opened + 2].strip() == left[opened + 1 : opened + 2]:
            starts = opened == 0 or not left[opened - 1].isalnum()
            ends = closed + 1 >= len(right) or not right[closed + 1].isalnum()
            out *= QUOTED if starts and ends else 1.0
        if {w.strip(".,;:!?\"“”").lower() for w in before[-BEFORE:]} & _REPORTS:
            out *= REPORTED
        return out

    def score(self, texts: list[str | None]) -> list[float]:
        split = [words_of(text) for text in texts]
        sets = [set(words) for words in split]
        every = set().union(*sets) if sets else set()
        if len(self.known) + len(every) > WORDS:
            self.known.clear()
        known = self.known
        for word in every:
            if word not in known:
                known[word] = self.weight(word)
        hits = {word for word in every if known[word] > 0}
        out = []
        for text, own in zip(texts, sets, strict=True):
            rest = 1.0 - REST
            if not hits.isdisjoint(own):
                small = text.lower()
                for m in _WORD.finditer(small):
                    if m.group() in hits:
                        rest *= 1.0 - known[m.group()] * self.context(small, m.start(), m.end())
            out.append(1.0 - rest)
        return out


def _evidence(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """Twice the log-likelihood ratio of a word's share among toxic documents; 0 if not above."""
    share = all_toxic / (all_toxic + all_clean)
    own = toxic / (toxic + clean)
    if own <= share:
        return 0.0
    out = toxic * math.log(own / share)
    if clean:
        out += clean * math.log((1 - own) / (1 - share))
    return 2 * out


def learn_lexicon(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Lexicon:
    """A lexicon from at most `rows` labelled documents outside the held-out third.

    Without toxic or without clean rows it is empty.
    """
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, "toxic", rows)
    schema = pa.schema([("word", pa.string()), ("label", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                words = sorted({"", *words_of(text)})
                columns = [pa.array(words, pa.string()), pa.array([label] * len(words), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    with rows_per_batch(spark, TEXTS_PER_BATCH):
        # The empty word stands in every document, so it counts them.
        counts = settle(
            sample.select("text", "label")
            .mapInArrow(run, "word string, label int")
            .groupBy("word")
            .agg(
                F.sum("label").cast("long").alias("toxic"),
                F.sum(1 - F.col("label")).cast("long").alias("clean"),
            ),
            "toxic-words",
        )
    whole = counts.where("word = ''").first()
    if whole is None or not whole["toxic"] or not whole["clean"]:
        return Lexicon()
    totals = whole["toxic"], whole["clean"]
    counts = counts.where("word != ''")

    def good(frame: DataFrame) -> list:
        """Rows of strong evidence: with `rows` labelled rows at most some thousands."""
        likely = frame.where(
            (F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1) >= PURITY
        ).where("toxic >= 3")
        return [r for r in likely.collect() if _evidence(r["toxic"], r["clean"], *totals) >= EVIDENCE]

    purity = lambda r: (r["toxic"] + 0.5) / (r["toxic"] + r["clean"] + 1)
    stem = F.explode(F.array(*[F.substring("word", 1, n) for n in STEM_LENGTHS])).alias("word")
    begun = (
        counts.where(F.length("word") >= min(STEM_LENGTHS))
        .select(stem, "toxic", "clean", F.col("word").alias("whole"))
        .distinct()
        .groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("*").alias("words"))
        .where(F.col("words") >= STEM_WORDS)
    )
    stems: dict[str, float] = {}
    for row in sorted(good(begun), key=lambda r: (len(r["word"]), r["word"])):
        if not any(row["word"].startswith(s) for s in stems):
            stems[row["word"]] = purity(row)
    terms = {r["word"]: purity(r) for r in good(counts)}
    terms = {t: w for t, w in terms.items() if not any(t.startswith(s) for s in stems)}
    lexicon = Lexicon(terms, stems)
    automaton_args = sorted(terms), sorted(stems)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TermAutomaton(*automaton_args)
        for batch in batches:
            found = [automaton.match(w) for w in batch.column(0).to_pylist()]
            near_term = pa.array([f[0] if f and f[1] else None for f in found], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, near_term], names=["word", "toxic", "clean", "term"]
            )

    # Words of the sample within the edits of a term, far fewer than its words.
    variants = (
        counts.select("word", "toxic", "clean")
        .mapInArrow(near, "word string, toxic long, clean long, term string")
        .where("term is not null")
        .collect()
    )
    lexicon.innocent = frozenset(r["word"] for r in variants if r["clean"] > 0)
    for term in terms:
        around = [r for r in variants if r["term"] == term]
        toxic = sum(r["toxic"] for r in around if not r["clean"])
        clean = sum(1 for r in around if r["clean"])
        # Where clean words often come this near by chance, an unseen one may be one of them.
        lexicon.misspelled[term] = UNSEEN * (toxic + 4) / (toxic + clean + 4)
    return lexicon


def toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per document held_out, score (0 to 1) and predicted (1 from a score of 0.7).

    `docs` has `doc_id` (integer) and `text`; other columns are not looked at. Null and empty texts
    have the score of a text without hits. Repeated and null ids give rows of their
    own; null ids count as held out. An empty table gives an empty result, an empty
    lexicon the same score for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            scores = pa.array(scorer.score(batch.column(1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with rows_per_batch(docs.sparkSession, TEXTS_PER_BATCH):
        scored = settle(texts.mapInArrow(run, "doc_id long, score double"), "toxicity")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The documents that are not toxic, as they are: one pass, in which no text moves."""
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS_PER_BATCH):
                batch = whole.slice(start, TEXTS_PER_BATCH)
                scores = scorer.score(batch.column(at).to_pylist())
                yield batch.filter(pa.array([score < TOXIC for score in scores]))

    return docs.mapInArrow(run, docs.schema)
