"""Operator 2, toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses at punctuation and line ends; words become classes
(insult, threat, target, negation, reported speech, other). Four transducers,
composed into one machine, rewrite the class sequence of a clause:

* negation: an insult or threat within ``SCOPE`` words after a negation is negated;
* reported speech: what follows a verb of saying in the clause is reported;
* target: an insult or threat in a clause that has named a target is aimed;
* insult and threat: what is left of them is output as a match.

So a clause yields matches such as "aimed insult" or "negated threat", never
bare words. A document's evidence is the number of matches of each kind and
their share of its words; their weights and the bias are fitted by logistic
regression on labelled rows.

The insult lexicon is learned: whole words and word beginnings (of ``STEM``
letters and more) that mark toxic training documents, with a count of distinct
left neighbours as support, so that copies of one document count once. It and
the weights are fitted on a bounded sample (``FIT_ROWS`` labelled documents of
each class, the smallest by a hash of the id; equal rows are one document).
Fitting and scoring read the texts whole; tasks reduce the sample to counts of
words and matches before anything is collected.

A word contracted with "not" (don't, aren't) is one word, a negation; other
apostrophes part words (he's, l'idiot).

Defined results: a null or empty text has no match and gets the score of a text
without evidence; labels with a null id or mark are not learned from; of several
marks of an id the largest holds; without labelled rows of both classes every
score is 0; repeated rows get equal results; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import slices, staged

FIT_ROWS = 2500
SCOPE = 3
STEM = 4
LONGEST_STEM = 9
LIMIT = 0.3
CACHE = 300_000
PAIRS = 500_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

#: fixed values: closed word classes of the grammar (English, German, French, Spanish)
TARGETS = """you your youre he she they them him her this these those du dich dir ihr euch er sie diese
tu toi vous il elle ils elles ce cette ces usted ustedes él ella ellos este esta esos""".split()
NEGATIONS = """not no never nobody nothing neither nor without isnt arent dont nicht kein keine nie niemals
pas jamais aucun aucune sans nunca jamás ningún ninguna sin""".split()
REPORTS = """said says say told claimed claims wrote quoted called according reported sagte sagt schrieb
behauptet dit disait écrit prétend dijo dice escribió afirma""".split()
THREATS = """kill hurt destroy murder beat punch stab shoot attack töten schlagen umbringen tuer frapper
détruire matar golpear destruir""".split()

TOKEN = re.compile(r"[^\W\d_]+(?:(?<=n)['’]t(?![^\W\d_]))?|[.!?;:,\n]")
CONTRACTED = ("n't", "n’t")
PUNCTUATION = frozenset(".!?;:,\n")

#: the kinds of match that the grammar outputs
KINDS = ("insult", "aimed insult", "negated insult", "reported insult",
         "threat", "aimed threat", "negated threat", "reported threat")


class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol); what has no entry
    keeps the state and copies the symbol."""

    def __init__(self, states: int, arcs: dict):
        self.states, self.arcs = states, arcs

    def step(self, state: int, symbol):
        return self.arcs.get((state, symbol), (state, symbol))


def negation() -> Transducer:
    """State: words left in the scope of a negation."""
    arcs = {}
    for s in range(SCOPE + 1):
        arcs[s, NEGATION] = (SCOPE, OTHER)
        for symbol in (OTHER, TARGET, REPORT):
            arcs[s, symbol] = (max(0, s - 1), symbol)
        for symbol in (INSULT, THREAT):
            arcs[s, symbol] = (max(0, s - 1), ("negated", symbol) if s else symbol)
    return Transducer(SCOPE + 1, arcs)


def reported() -> Transducer:
    """State 1: after a verb of saying."""
    arcs = {(s, REPORT): (1, OTHER) for s in (0, 1)}
    arcs |= {(1, symbol): (1, ("reported", symbol)) for symbol in (INSULT, THREAT)}
    return Transducer(2, arcs)


def target() -> Transducer:
    """State 1: the clause has named a target."""
    arcs = {(s, TARGET): (1, OTHER) for s in (0, 1)}
    arcs |= {(1, symbol): (1, ("aimed", symbol)) for symbol in (INSULT, THREAT)}
    return Transducer(2, arcs)


def matches() -> Transducer:
    """Outputs the kind of a match, or None."""
    name = {INSULT: "insult", THREAT: "threat"}
    arcs = {(0, symbol): (0, None) for symbol in (OTHER, TARGET, NEGATION, REPORT)}
    for symbol, word in name.items():
        arcs[0, symbol] = (0, KINDS.index(word))
        for how in ("aimed", "negated", "reported"):
            arcs[0, (how, symbol)] = (0, KINDS.index(f"{how} {word}"))
    return Transducer(1, arcs)


def compose(*cascade: Transducer) -> tuple[list[list[int]], list[list[int | None]]]:
    """The cascade as one machine over classes: next state and output by
    [state][class]; only reachable states."""
    start = (0,) * len(cascade)
    number, todo, move, emit = {start: 0}, [start], [], []
    while todo:
        state = todo.pop(0)
        row, out = [], []
        for symbol in range(6):
            after = []
            for t, s in zip(cascade, state):
                s, symbol = t.step(s, symbol)
                after.append(s)
            after = tuple(after)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
            out.append(symbol)
        move.append(row)
        emit.append(out)
    return move, emit


class Lexicon(dict):
    """Word -> class; unknown words are classed by the patterns when first
    asked for (at most ``CACHE`` are kept)."""

    def __init__(self, words: list[str], stems: list[str]):
        self.words, self.stems = frozenset(words), frozenset(stems)
        self.closed = {w: c for ws, c in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT),
                                          (THREATS, THREAT)) for w in ws}
        super().__init__()

    def __missing__(self, word: str) -> int:
        found = word in self.words or any(word[:i] in self.stems for i in range(STEM, min(len(word), LONGEST_STEM) + 1))
        kind = NEGATION if word.endswith(CONTRACTED) else INSULT if found else self.closed.get(word, OTHER)
        if len(self) >= CACHE:
            self.clear()
        self[word] = kind
        return kind

    def __reduce__(self):
        return Lexicon, (list(self.words), list(self.stems))


class Grammar:
    """The composed machine, a lexicon and the weights of the matches."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.move, self.emit = compose(negation(), reported(), target(), matches())
        self.weights: np.ndarray | None = None

    def evidence(self, text: str | None) -> list[float]:
        """Counts of matches by kind, then the number of words."""
        tokens = TOKEN.findall((text or "").lower())
        get = self.lexicon
        classes = [None if t in PUNCTUATION else get[t] for t in tokens]
        counts = [0.0] * len(KINDS)
        words = len(tokens) - classes.count(None)
        if INSULT in classes or THREAT in classes:
            state = 0
            for c in classes:
                if c is None:
                    state = 0
                    continue
                kind = self.emit[state][c]
                state = self.move[state][c]
                if kind is not None:
                    counts[kind] += 1
        return [*counts, float(words)]

    @staticmethod
    def features(evidence: np.ndarray) -> np.ndarray:
        counts, words = evidence[:, :-1], np.maximum(evidence[:, -1:], 1)
        share = np.sqrt(counts.sum(axis=1, keepdims=True) / words)
        return np.hstack([np.log1p(counts), share * 5, np.ones((len(counts), 1))])

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(evidence))
        return 1 / (1 + np.exp(-np.clip(self.features(evidence) @ self.weights, -30, 30)))


def _marks(batches):
    """Rows (pattern, before, n_toxic, n_clean) to be summed: documents by
    pattern (``before`` null), and left neighbours in toxic documents."""
    def patterns(word: str):
        yield word + "$"
        for i in range(STEM, min(len(word), LONGEST_STEM) + 1):
            yield word[:i]

    count, left = (defaultdict(int), defaultdict(int)), set()

    def flush():
        keys = sorted(count[0].keys() | count[1].keys())
        pairs = sorted(left)
        zeros = [0] * len(pairs)
        yield pa.RecordBatch.from_arrays([
            pa.array(keys + [p for p, _ in pairs], pa.string()),
            pa.array([None] * len(keys) + [w for _, w in pairs], pa.string()),
            pa.array([count[1].get(k, 0) for k in keys] + zeros, pa.int64()),
            pa.array([count[0].get(k, 0) for k in keys] + zeros, pa.int64())],
            names=["pattern", "before", "n_toxic", "n_clean"])
        for c in (*count, left):
            c.clear()

    for b in slices(batches, "text"):
        for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist()):
            here, before = set(), ""
            for m in TOKEN.finditer((text or "").lower()):
                word = m.group()
                if word in PUNCTUATION:
                    continue
                if len(word) >= STEM and not word.endswith(CONTRACTED):
                    found = [*patterns(word)]
                    here.update(found)
                    if toxic:
                        left.update((p, before) for p in found)
                        if len(left) > PAIRS:
                            yield from flush()
                before = word
            for p in here:
                count[1 if toxic else 0][p] += 1
            if len(count[0]) + len(count[1]) > PAIRS:
                yield from flush()
    yield from flush()


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int, prior: float) -> Lexicon:
    """Words and beginnings whose documents are toxic with probability 0.8 or
    more at the base rate ``prior``, with enough distinct left neighbours.
    ``sample`` has ``n_toxic`` and ``n_clean`` rows of the classes."""
    least = max(3, 0.004 * n_toxic)
    t = F.col("t") / n_toxic * prior
    c = (F.col("c") + 0.25) / n_clean * (1 - prior)
    found = sample.select("toxic", "text") \
        .mapInArrow(_marks, "pattern string, before string, n_toxic long, n_clean long") \
        .groupBy("pattern", "before").agg(F.sum("n_toxic").alias("t"), F.sum("n_clean").alias("c")) \
        .groupBy("pattern").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count("before").alias("n_left")) \
        .filter((F.col("t") >= least) & (F.col("n_left") >= least) & (t / (t + c) >= 0.8))
    good = {r["pattern"] for r in found.select("pattern").collect()}
    stems = sorted((p for p in good if not p.endswith("$")), key=lambda p: (len(p), p))
    kept: set[str] = set()
    for p in stems:
        if not any(p[:i] in kept for i in range(STEM, len(p))):
            kept.add(p)
    words = [p[:-1] for p in good if p.endswith("$")]
    return Lexicon([w for w in words if not any(w[:i] in kept for i in range(STEM, len(w) + 1))], sorted(kept))


def _evidence(grammar: Grammar):
    def run(batches):
        for b in slices(batches, "text"):
            found = [grammar.evidence(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), b.column("toxic"), pa.array(found, pa.list_(pa.float64()))],
                names=["doc_id", "key", "toxic", "evidence"])
    return run


def fit(sample: DataFrame, n_toxic: int, n_clean: int) -> Grammar | None:
    """Grammar from rows (doc_id, key, toxic, text); the class sizes are those
    of all labelled training rows."""
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(True) or not n.get(False):
        return None
    prior = n_toxic / (n_toxic + n_clean)
    grammar = Grammar(learn_lexicon(sample, n[True], n[False], prior))
    rows = sample.mapInArrow(_evidence(grammar), "doc_id long, key long, toxic boolean, evidence array<double>") \
        .orderBy("doc_id", "key").collect()
    y = np.array([float(r["toxic"]) for r in rows])
    x = grammar.features(np.array([r["evidence"] for r in rows]))
    w = np.where(y == 1, prior / n[True], (1 - prior) / n[False])
    beta, ridge = np.zeros(x.shape[1]), 1e-4 * np.eye(x.shape[1])
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    grammar.weights = beta
    return grammar


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Grammar | None:
    """Fit on at most ``fit_rows`` labelled documents of each class. ``docs``
    (doc_id, text) and ``labels`` (doc_id, toxic) must be training rows."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = marks.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= fit_rows).select("doc_id", "toxic")
    # repeated ids: at most fit_rows distinct texts of a class, ranked without them
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    rank = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "key")
    chosen = keyed.select("doc_id", "key").join(F.broadcast(drawn), "doc_id").distinct() \
        .withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= fit_rows).drop("n")
    sample = keyed.join(F.broadcast(chosen), ["doc_id", "key"]).groupBy("doc_id", "key", "toxic") \
        .agg(F.first("text").alias("text")).withColumn("toxic", F.col("toxic") != 0)
    return fit(staged(sample, "toxicity-sample"), size.get(1, 0), size.get(0, 0))


def score(docs: DataFrame, grammar: Grammar | None) -> DataFrame:
    """One row per document: doc_id, score, predicted and its match counts."""
    def run(batches):
        for b in slices(batches, "text"):
            found = np.zeros((b.num_rows, len(KINDS) + 1))
            p = np.zeros(b.num_rows)
            if grammar:
                found = np.array([grammar.evidence(t) for t in b.column("text").to_pylist()])
                p = grammar.score(found)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(p), pa.array((p >= LIMIT).astype(np.int32)),
                 pa.array(found[:, :-1].sum(axis=1).astype(np.int64))],
                names=["doc_id", "score", "predicted", "n_matches"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, n_matches long")
