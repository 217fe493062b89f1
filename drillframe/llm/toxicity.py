"""Toxicity by a weighted finite-state pattern grammar.

A lexicon tags words as insult, verb of harm, target, negation, reporting verb or intent; punctuation is tagged too.
Transducers are composed over the tags of a text, read forwards and then backwards:

- negation takes insults and threats in its scope back, unless it is a "not only";
- reported speech marks those that somebody other than the writer is said to have uttered: what follows a reporting verb
  to the end of the clause, and whole quotations before or after one, over colons and sentence ends within the quotation;
- target marks insults near somebody they are aimed at, before or after, and makes a verb of harm a threat only if its
  object is somebody; intent before it makes the threat a stated one. Verbs of harm without such an object count for next
  to nothing.

Each tag that comes out has a weight, and a document's score is a logistic function of the weighted sum over its matched
clauses. A paragraph's end resets all.

English words are given; further stems and words, of any language, are learned from labelled rows, as are the weights of
the composed tags (drawn to the given ones, which stand where labels tell nothing) and the logistic function's two
numbers. What is learned from is a bounded sample (SAMPLE_ROWS), scored is every whole text: an Aho-Corasick automaton
finds insults and verbs of harm, and only texts that hold one are run through the grammar.

Edge cases: a null, empty or blank text has no clauses and the lowest score; repeated rows score alike and each keeps
its row; without labelled rows of both kinds only the given words and default numbers are used; an empty table gives
an empty result; further columns of the input are ignored (kept by drop_toxic()), whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, plain_text

#: Most labelled rows that the lexicon is learned from.
SAMPLE_ROWS = 8000
THRESHOLD = 0.5
#: Log-odds below which a feature isn't taken, and from which its weight is one.
LEAST_ODDS, SURE_ODDS = 2.0, 5.0
#: Rows of label 0 that a form of a stem must stand in to be an exception to it.
LEAST_ROWS = 3

#: The given words, by tag.
LEXICON = {
    "I": "idiot idiots moron morons scum trash loser losers stupid pathetic worthless disgusting clown imbecile dumbass bastard",
    "H": "kill murder strangle stab hurt destroy beat shoot burn töten umbringen tuer matar",
    "T": "you you're yourself yourselves u he him she her they them these those du dich ihr euch sie tu toi vous te tú usted ustedes ellos",
    "Y": "your dein deine ton ta tes votre vos",
    "N": "not no never neither nor isn't aren't wasn't weren't don't doesn't didn't won't cannot can't nicht kein keine keinen nie pas jamais ni nunca ningún",
    "K": "only just merely nur seulement solo sólo",
    "R": "said says say saying called calls calling wrote writes claimed claims told reported reports quoted shouted yelled replied sagte schrieb nannte rief dit disait écrit cria dijo llamó escribió gritó",
    "M": "i we ich wir je j'ai nous yo nosotros",
    "F": "will i'll we'll gonna going shall must want werde werden vais va voy",
}
MARKS = {**dict.fromkeys("\"“”„«»", "Q"), **dict.fromkeys((",", "-", "--", "–", "—"), "C"), ":": "L", **dict.fromkeys(".!?;…", "E"), "\n": "P"}

#: Weights of the tags that come out. I insult, A aimed insult, B threat, X threat with stated intent, i insult taken back,
#: r reported insult or threat, h verb of harm that is no threat.
WEIGHTS = {"I": 1.0, "A": 1.4, "B": 1.4, "X": 1.8, "i": 0.1, "r": 0.12, "h": 0.03}
SCORED = "".join(WEIGHTS)
#: All tags: those of the lexicon and of marks, W for any other word, those of WEIGHTS, and G, an intended harm on its way.
ALL_TAGS = "IHTYNKRMFQCLEPWABXirhG"


class Transducer:
    """A letter-to-letter transducer. step(state, tag) -> (state, tag); start is state 0. Steps are tabulated once."""

    def __init__(self, step, states: int, tags: str = ALL_TAGS):
        self.table = {(s, t): step(s, t) for s in range(states) for t in tags}
        self.states, self.tags = states, tags

    def __call__(self, tags: str) -> str:
        state, out, table = 0, [], self.table
        for t in tags:
            state, t = table[state, t]
            out.append(t)
        return "".join(out)

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what self writes."""

        def step(state: int, tag: str) -> tuple[int, str]:
            mine, theirs = divmod(state, other.states)
            mine, middle = self.table[mine, tag]
            theirs, out = other.table[theirs, middle]
            return mine * other.states + theirs, out

        return Transducer(step, self.states * other.states, self.tags)


def near(first: str, words: int, becomes: dict[str, str], ends: str = "EP"):
    """A step that changes tags in the `words` words after a tag of `first`; marks of `ends` end its scope."""

    def step(state: int, tag: str) -> tuple[int, str]:
        if tag in first:
            return words, tag
        if tag in ends:
            return 0, tag
        return max(0, state - (tag not in "QCL")), becomes.get(tag, tag) if state else tag

    return step


#: The three words after a negation are taken back; a comma, a sentence's end and "only" end its scope.
negation = near("N", 3, {"I": "i", "H": "h"}, "CEPK")


def reported(state: int, tag: str) -> tuple[int, str]:
    """State 1: after the writer's own pronoun. 2: after a reporting verb. 3: within the quotation that follows one."""
    if state == 3:
        return (0 if tag in "QP" else 3), "r" if tag in "IH" else tag
    if tag == "R":
        return (0 if state == 1 else 2), tag
    if tag == "Q":
        return (3 if state == 2 else 0), tag
    if tag in "EP" or state < 2:
        return int(tag == "M"), tag
    return 2, "r" if tag in "IH" else tag


def reported_after(state: int, tag: str) -> tuple[int, str]:
    """Read backwards. States 1 to 3: a reporting verb within so many words. 4: within the quotation before it."""
    if state == 4:
        return (0 if tag in "QP" else 4), "r" if tag in "IHABXGh" else tag
    if tag == "R":
        return 3, tag
    if tag == "Q":
        return (4 if state else 0), tag
    return (0 if tag in "EPM" else max(0, state - (tag not in "CL"))), tag


def harmless(state: int, tag: str) -> tuple[int, str]:
    """Verbs of harm that nothing has made a threat."""
    return 0, "h" if tag in "HG" else tag


FORWARD = Transducer(negation, 4).then(Transducer(reported, 4)).then(Transducer(near("TY", 4, {"I": "A"}), 5)).then(Transducer(near("F", 4, {"H": "G"}), 5))
#: Read from the end, for targets and reporting verbs that follow.
BACKWARD = Transducer(reported_after, 5).then(Transducer(near("T", 4, {"I": "A"}), 5)).then(Transducer(near("T", 3, {"H": "B", "G": "X"}), 4)).then(Transducer(harmless, 1))

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_TOKEN = re.compile(_WORD.pattern + r"|[\"“”„«»,:.!?;…\n–—]|--?")


def composed(tags: str) -> str:
    """The tags of a text after all transducers."""
    return BACKWARD(FORWARD(tags)[::-1])[::-1]


@dataclass
class Grammar:
    """words: whole words, stems: beginnings of words, with their tag and lexical weight. weights: of composed tags."""

    words: dict[str, tuple[str, float]] = field(default_factory=dict)
    stems: dict[str, tuple[str, float]] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    slope: float = 4.0
    bias: float = -3.0

    @classmethod
    def given(cls) -> Grammar:
        return cls(words={w: (t, 1.0) for t, ws in LEXICON.items() for w in ws.split()})

    def tag(self, word: str) -> tuple[str, float]:
        found = self.words.get(word)
        if found is None:
            found = next((self.stems[word[:k]] for k in range(len(word), 2, -1) if word[:k] in self.stems), ("W", 1.0))
        return found

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for entries, whole in ((self.words, True), (self.stems, False)):
            for w, (t, _) in entries.items():
                if t in "IH":
                    found.add_word(w, (len(w), whole))
        found.make_automaton()
        return found

    def sums(self, text: str, automaton: ahocorasick.Automaton, known: dict | None = None) -> dict[str, float]:
        """The sum of lexical weights by composed tag; empty if the text holds no insult and no verb of harm."""
        low = text.lower().replace("’", "'")
        if not any(not (last + 1 > size and low[last - size].isalnum()) and not (whole and last + 1 < len(low) and low[last + 1].isalnum()) for last, (size, whole) in automaton.iter(low)):
            return {}
        known = {} if known is None else known
        tagged = []
        for t in _TOKEN.findall(low):
            if t not in known:
                known[t] = (MARKS[t], 1.0) if t in MARKS else self.tag(t)
            tagged.append(known[t])
        out: dict[str, float] = {}
        for t, (_, w) in zip(composed("".join([t for t, _ in tagged])), tagged):
            if t in WEIGHTS:
                out[t] = out.get(t, 0.0) + w
        return out

    def strength(self, sums: dict[str, float]) -> float:
        return sum(self.weights[t] * x for t, x in sums.items())

    def score(self, sums: dict[str, float]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * math.log1p(self.strength(sums))))))

    def score_all(self, texts: list[str], automaton: ahocorasick.Automaton) -> list[float]:
        known: dict[str, tuple[str, float]] = {}
        out = []
        for t in texts:
            out.append(self.score(self.sums(t, automaton, known)))
            if len(known) > REMEMBERED:
                known.clear()
        return out


#: Words whose tags a worker remembers.
REMEMBERED = 200_000


def _features(text: str) -> set[str]:
    """Words, and beginnings of words, of four to six letters and more than those, marked with a star."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in (4, 5, 6) if len(w) > k}


def _log_odds(marked: int, clean: int, rows: Counter) -> float:
    """Of a feature that so many rows of either label hold, out of rows[label]."""
    return math.log((marked + 0.5) / (rows[1] + 1)) - math.log((clean + 0.5) / (rows[0] + 1))


def learn_lexicon(grammar: Grammar, rows: list[tuple[str, int]]) -> None:
    """Adds words and stems that mark label 1, one by one, each the one that tells most about rows not marked so far.

    A feature must stand in so many rows of label 1 that chance would give not even one such feature among all that
    were looked at. Its weight grows with its log-odds.
    """
    marked = [_features(t) for t, y in rows if y]
    seen = Counter(f for fs in marked for f in fs)
    share = len(marked) / len(rows)
    least = max(LEAST_ROWS, math.ceil(math.log(0.1 / max(len(seen), 1)) / math.log(share)))
    hopeful = {f for f, n in seen.items() if n >= least}
    against = Counter(f for t, y in rows if not y for f in _features(t) & hopeful)
    counts = Counter(y for _, y in rows)
    odds = {f: _log_odds(seen[f], against[f], counts) for f in hopeful}
    useful = {f for f in hopeful if odds[f] >= LEAST_ODDS}
    left = [fs & useful for fs in marked]
    while gains := Counter(f for fs in left for f in fs):
        best = max(gains, key=lambda f: (gains[f] * odds[f], len(f), f))
        if gains[best] < 2:
            break
        found = ("I", round(min(1.0, odds[best] / SURE_ODDS), 3))
        if best.endswith("*"):
            grammar.stems[best[:-1]] = found
        else:
            grammar.words[best] = found
        left = [fs for fs in left if best not in fs]
    except_forms(grammar, rows)


def except_forms(grammar: Grammar, rows: list[tuple[str, int]]) -> None:
    """Words that begin with a learned stem but don't mark label 1 themselves become plain words, and the stem is weighed
    again by the words that are left to it."""
    counts = Counter(y for _, y in rows)
    for stem in list(grammar.stems):
        forms = [({w for w in _WORD.findall(t.lower()) if w.startswith(stem)}, y) for t, y in rows if stem in t.lower()]
        marked, clean = Counter(w for ws, y in forms if y for w in ws), Counter(w for ws, y in forms if not y for w in ws)
        plain = {w for w, n in clean.items() if n >= LEAST_ROWS and w not in grammar.words and _log_odds(marked[w], n, counts) < LEAST_ODDS}
        grammar.words |= {w: ("W", 1.0) for w in plain}
        odds = _log_odds(sum(bool(ws - plain) for ws, y in forms if y), sum(bool(ws - plain) for ws, y in forms if not y), counts)
        grammar.stems[stem] = ("I", round(max(0.0, min(1.0, odds / SURE_ODDS)), 3))


def fit_weights(grammar: Grammar, rows: list[tuple[str, int]], steps: int = 300) -> None:
    """Slope, bias and the weights of composed tags, by ascent on the likelihood with a pull to the given numbers."""
    automaton, known = grammar.automaton(), {}
    sums = [grammar.sums(t, automaton, known) for t, _ in rows]
    x = np.array([[s.get(t, 0.0) for t in SCORED] for s in sums])
    y = np.array([label for _, label in rows], float)
    given = np.array([grammar.slope, grammar.bias, *[math.log(WEIGHTS[t]) for t in SCORED]])
    pull = np.array([0.5, 0.5, *[16.0] * len(SCORED)])
    at, mean, spread = given.copy(), np.zeros(len(given)), np.zeros(len(given))
    for turn in range(1, steps + 1):
        weights = np.exp(at[2:])
        total = x @ weights
        logs = np.log1p(total)
        away = y - 1 / (1 + np.exp(-np.clip(at[0] * logs + at[1], -30, 30)))
        slope = np.array([away @ logs, away.sum(), *((away * at[0] / (1 + total)) @ x * weights)]) - pull * (at - given)
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        at += 0.1 * (1 - turn / (steps + 1)) * (mean / (1 - 0.9**turn)) / (np.sqrt(spread / (1 - 0.99**turn)) + 1e-8)
    grammar.slope, grammar.bias = float(at[0]), float(at[1])
    grammar.weights = {t: float(np.exp(w)) for t, w in zip(SCORED, at[2:])}


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Grammar:
    """A grammar learned from at most `rows` labelled rows outside the held-out fold."""
    grammar, sample = Grammar.given(), labelled_sample(docs, labels, "toxic", rows)
    if len({y for _, y in sample}) == 2:
        learn_lexicon(grammar, sample)
        fit_weights(grammar, sample)
    return grammar


def scores(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """rest (the columns of docs but text, packed), text and score of each row."""
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"), plain_text().alias("text"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = grammar.automaton()
        for b in batches:
            score = grammar.score_all(b["text"].to_pylist(), automaton)
            yield pa.RecordBatch.from_arrays([b["rest"], b["text"], pa.array(score, pa.float64())], ["rest", "text", "score"])

    return rows.mapInArrow(mapped, f"rest {rows.schema['rest'].dataType.simpleString()}, text string, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, one row per document."""
    out = scores(docs.select("doc_id", "text"), fit(docs, labels)).select("rest.doc_id", "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score as toxic; a null text stays, as an empty one."""
    kept = scores(docs, fit(docs, labels)).where(F.col("score") < THRESHOLD)
    return kept.select(*[F.col(c) if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])
