"""Toxicity: a weighted finite-state pattern grammar.

Five transducers over the words of a clause, each a small table (``transducers.scope``):
negation (an insult or threat shortly after a negation is *denied*), reported speech (what follows
a verb of saying in its clause is *quoted*), insult (a target shortly after an insult is *struck*), target (an
insult shortly after a target is *aimed*), threat (a target shortly after a threat verb is a *menace*).
A lexicon gives each word its class and, for insult forms, a weight; the composition of the
five machines, made as its states are reached, rewrites the classes of a clause.  A document's features
are sums over its matched clauses: of the weights of insults (plain or aimed), denied and quoted ones, of
the strikes and menaces, and how many clauses hold an insult; a logistic layer gives the probability.

The insult forms (whole words and stems) and their weights, log-ratios of their rates in toxic and in other texts, are
learned from a bounded sample of labelled rows; the fixed seed words stay beside them unless the sample
shows them in other texts.  The layer's weights are learned on the same rows, pulled
towards fixed prior weights.  The words of the other classes are fixed values.

Defined results: a null or empty text matches nothing and gets the score of no
match; repeated rows get equal scores; an empty table gives an empty table;
texts are read whole, memory is bounded by one batch.  Without toxic labels the
fixed insult words and prior weights are used.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroseries.llm.common import fold, labelled_sample, text_or_empty, with_column
from hydroseries.llm.transducers import compose, scope

# Words of the grammar's closed classes.
SEED_INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "worthless", "pathetic",
                "disgusting", "trash", "imbecile", "bastard")
THREATS = ("kill", "hurt", "destroy", "burn", "shoot", "stab", "punish", "strangle")
TARGETS = ("you", "your", "yours", "he", "she", "they", "them", "him", "her", "their", "du", "dich", "ihr", "sie", "tu", "vous",
           "toi", "usted", "ellos")
NEGATIONS = ("not", "never", "no", "without", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "sin")
REPORTS = ("said", "says", "wrote", "quoted", "called", "claimed", "reported", "according", "sagte", "schrieb", "dit", "dijo")

PLAIN, DENIED, QUOTED, STRUCK, MENACE, CLAUSES = range(6)
PRIOR = np.array([0.8, 0.1, 0.1, 0.8, 3.0, 0.3])
PRIOR_BIAS = -3.5
SEED_WEIGHT = 6.0
WORDS = re.compile(r"\w+")
CLAUSE_END = re.compile(r"[.!?;\n]+")
SCOPE = 4  # words over which a negation, an insult, a target or a threat verb reaches
STEMS = (4, 5, 6, 7, 8)
CAP = np.array([20.0, 20.0, 20.0, 4.0, 2.0, 8.0])  # sums beyond say no more

NEGATION = scope(["negation"], {"insult": "denied", "threat": "denied"}, SCOPE)
REPORTED = scope(["report"], {"insult": "quoted", "denied": "quoted", "threat": "quoted"}, None)
INSULT = scope(["insult"], {"target": "struck"}, SCOPE)
TARGET = scope(["target", "struck"], {"insult": "aimed"}, SCOPE)
THREAT = scope(["threat"], {"target": "menace", "struck": "menace"}, SCOPE)
MACHINES = (NEGATION, REPORTED, INSULT, TARGET, THREAT)
# what a written symbol counts in: (feature, by the insult's weight or as one)
COUNTS = {"insult": ((PLAIN, True),), "aimed": ((PLAIN, True), (STRUCK, False)), "denied": ((DENIED, True),), "quoted": ((QUOTED, True),),
          "struck": ((STRUCK, False),), "menace": ((MENACE, False),)}


class Grammar:
    """Lexicon and composed machines, with the weights of the logistic layer."""

    def __init__(self, forms: dict[str, float], weights, bias: float):
        self.forms, self.weights, self.bias = dict(forms), np.asarray(weights, dtype=float), float(bias)
        self.closed = {w: k for k, ws in (("threat", THREATS), ("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in ws}
        self.machine = compose(MACHINES)

    def __getstate__(self):
        return self.forms, self.weights, self.bias

    def __setstate__(self, s):
        self.__init__(*s)

    def label(self, word: str) -> tuple[str, float]:
        """Class and weight of a lower-case word: of its whole form and stems the heaviest insult, else its closed class."""
        found = [self.forms.get(word)] + [self.forms.get(word[:n] + "*") for n in STEMS if len(word) > n]
        found = [w for w in found if w is not None]
        if found:
            return "insult", max(found)
        return self.closed.get(word, "word"), 0.0

    def clause(self, text: str) -> np.ndarray:
        """Features of one clause."""
        got, state = np.zeros(len(PRIOR)), self.machine.start
        for m in WORDS.finditer(text):
            kind, w = self.label(m[0])
            state, out, _ = self.machine.step(state, kind)
            for c, weighed in COUNTS.get(out, ()):
                got[c] += (w or 1.0) if weighed else 1.0
        got[CLAUSES] = got[PLAIN] > 0
        return got

    def automaton(self):
        """Finds clauses worth parsing: those with a form or a threat verb."""
        import ahocorasick
        a = ahocorasick.Automaton()
        for f in [*self.forms, *THREATS]:
            a.add_word(f.rstrip("*"), len(f.rstrip("*")))
        a.make_automaton()
        return a

    def features(self, text: str, finder) -> np.ndarray:
        low = text.lower()
        total, done = np.zeros(len(PRIOR)), -1
        for end, n in finder.iter(low):
            at = end - n + 1
            if at <= done or (at and (low[at - 1].isalnum() or low[at - 1] == "_")):
                continue
            begin = max(low.rfind(c, 0, at) for c in ".!?;\n") + 1
            stop = CLAUSE_END.search(low, at)
            done = stop.start() if stop else len(low)
            total += self.clause(low[max(begin, 0):done])
        return np.minimum(total, CAP)

    def score(self, text: str, finder) -> float:
        x = float(self.features(text, finder) @ self.weights + self.bias)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def learn_forms(sample: list[tuple[str, int]], risk: float = 0.01, least: float = 1.5) -> dict[str, float]:
    """Whole words and stems (``abcd*``) with their weights: the log-ratio of a form's rates in toxic and other texts.

    A form between ``d1`` different pairs of neighbours in ``n1`` toxic texts and in ``d0`` of the other texts is
    kept if the log-ratio is at least ``least`` and the two rates differ by more than chance explains (the
    likelihood ratio, corrected for the number of forms, is less likely than ``risk``)."""
    counts, n = (Counter(), Counter()), [0, 0]
    for text, y in sample:
        words = set(WORDS.findall(text.lower()))
        counts[y].update(words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k})
        n[y] += 1
    if not all(n):
        return {}
    need = math.log(max(len(counts[1]), 1) / risk)
    share = n[1] / sum(n)

    def evidence(d1, d0):
        """(log-ratio of the rates, half the likelihood ratio) if the form is in d1 and d0 texts."""
        ratio = math.log((d1 + 0.5) / (n[1] + 1)) - math.log((d0 + 0.5) / (n[0] + 1))
        d = d1 + d0
        return ratio, d1 * math.log(d1 / (d * share)) + (d0 * math.log(d0 / (d * (1 - share))) if d0 else 0.0)
    good = lambda e: e[0] >= least and e[1] >= need
    seen = {f: set() for f, d in counts[1].items() if good(evidence(d, counts[0].get(f, 0)))}
    for text, y in sample:
        words = WORDS.findall(text.lower()) if y else []
        for before, w, after in zip(["", *words], words, [*words[1:], ""]):
            # copies of one text repeat the neighbours too: each pair of neighbours supports a form once
            for f in (w, *(w[:k] + "*" for k in STEMS if len(w) > k)):
                if f in seen:
                    seen[f].add((before, after))
    kept = {f: evidence(min(len(places), counts[1][f]), counts[0].get(f, 0)) for f, places in seen.items()}
    kept = {f: e[0] for f, e in kept.items() if good(e)}
    for w in SEED_INSULTS:
        if not counts[0].get(w) and w not in kept:
            kept[w] = SEED_WEIGHT
    # a form adds nothing beside a stem of it that weighs as much
    stems = lambda f: [f"{f[:k]}*" for k in STEMS if len(f.rstrip("*")) > k]
    return {f: w for f, w in kept.items() if not any(kept.get(s, -1.0) >= w for s in stems(f))}


def fit_weights(x: np.ndarray, y: np.ndarray, sample_rate: np.ndarray, strength: float = 0.05, steps: int = 30):
    """Logistic weights by Newton steps, pulled towards the prior; ``sample_rate``
    weighs rows by how many rows of the training folds each stands for."""
    w, p0 = np.append(PRIOR, PRIOR_BIAS), np.append(PRIOR, PRIOR_BIAS)
    xb = np.column_stack([x, np.ones(len(x))])
    pull = strength * len(x) / 100 * np.eye(len(w))
    pull[-1, -1] *= 0.1
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -30, 30)))
        g = xb.T @ (sample_rate * (p - y)) + pull @ (w - p0)
        h = xb.T @ (xb * (sample_rate * p * (1 - p))[:, None]) + pull
        w = w - np.linalg.solve(h, g)
    return w[:-1], w[-1]


def train(sample: list[tuple[str, int]], counts: dict[int, int]) -> Grammar:
    """Forms from all of the sample; the layer's weights from features that each half gets
    with the forms of the other, so that chance forms do not look better than they are."""
    seeds = dict.fromkeys(SEED_INSULTS, SEED_WEIGHT)
    g = Grammar(learn_forms(sample) or seeds, PRIOR, PRIOR_BIAS)
    ys = np.array([y for _, y in sample], dtype=float)
    if len(set(ys)) < 2:
        return g
    x = np.zeros((len(sample), len(PRIOR)))
    for half in (0, 1):
        other = Grammar(learn_forms([r for i, r in enumerate(sample) if i % 2 != half]) or seeds, PRIOR, PRIOR_BIAS)
        finder = other.automaton()
        for i in range(half, len(sample), 2):
            x[i] = other.features(sample[i][0], finder)
    n = {c: max(1, int((ys == c).sum())) for c in (0, 1)}
    rate = np.where(ys == 1, counts.get(1, n[1]) / n[1], counts.get(0, n[0]) / n[0])
    g.weights, g.bias = fit_weights(x, ys, rate / rate.mean())
    return g


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> Grammar:
    """Grammar from at most ``per_class`` labelled rows of each class of the training folds."""
    sample, counts = labelled_sample(docs, labels, "toxic", 5, 0, per_class)
    return train(sample, counts)


def classify(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """Adds held_out, score, predicted; other columns of docs stay."""
    def start():
        finder = grammar.automaton()
        return lambda texts: [grammar.score(t, finder) for t in texts]

    got = docs.drop("_text", "held_out", "predicted").withColumn("_text", text_or_empty())
    got = with_column(got, "score", T.DoubleType(), start, ["_text"], [c for c in got.columns if c not in ("_text", "score")])
    return got.withColumn("held_out", fold("doc_id", 5) == 0).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
