"""Toxicity by a weighted finite-state pattern grammar.

A text is read as clauses. A cascade of transducers goes over the words of each:
PHRASES makes threats of several words one symbol, NEGATED denies what stands
behind a negation, AIMED joins insults and threats with the targets near them,
REPORTED marks what is only quoted. ``compose`` makes one machine of them, whose
arcs are a table; what it puts out is weighed and summed by clause. The insult
symbols' words and stems, with their weights, are learned from labelled
documents, as is the logistic map from clause scores to a probability.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, crc_fold, lean, tune

#: Closed word classes of the grammar in its four languages.
THREATS = "kill hurt stab shoot beat destroy töte töten umbringen schlagen matar matarte herir golpear tuer tuerai frapper".split()
TARGETS = "you your yourself u he she they them him du dich dir ihr sie er tú te usted ustedes él ella tu toi vous il elle ils".split()
NEGATIONS = "not never no nobody isn't aren't wasn't don't nicht kein keine nie niemals nunca jamás ningún pas jamais aucun".split()
REPORTS = "said says wrote writes quoted claimed alleged sagte sagt schrieb dijo dice escribió dit écrit affirme".split()
MODALS = "will gonna shall werde wirst voy vas vais".split()
#: Words that begin a clause of their own.
CONJUNCTIONS = "but because although aber weil obwohl pero porque aunque mais parce".split()
#: Threats of several words; the last word is where the threat is.
PHRASES = ["watch your back", "find out where you live", "you will regret", "wirst es bereuen", "weiß wo du wohnst", "sé dónde vives", "sais où tu habites"]
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, MODAL = range(7)
#: What the cascade puts out besides; what an insult counts there, and what comes
#: on top without one.
DENIED, AIMED, AIM, THREATENED, QUOTED = range(7, 12)
FACTOR, EXTRA = {INSULT: 1.0, AIMED: 1.25, DENIED: 0.5, QUOTED: 0.5}, {AIM: 0.25, THREATENED: 0.5}
#: Stem lengths tried besides whole words, and how far a target or negation reaches.
STEMS, REACH = (4, 5, 6, 7, 8), 3
#: Labelled rows that teach, and those of them that the probabilities are fitted
#: on, at most; chunks of text a worker remembers (the first it meets).
LABELLED, FIT_ROWS, MEMO = 200_000, 20_000, 150_000
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")
FEATURES = ("top", "sum", "clauses", "negated", "reported", "threats")


@dataclass(frozen=True)
class Machine:
    """A transducer that puts out one symbol for each it reads: ``arcs`` of state
    (the first is 0) and symbol read are the next state and the symbol put out."""

    arcs: dict[tuple[int, int], tuple[int, int]]

    def run(self, symbols: list[int]) -> list[int]:
        state, out = 0, []
        for x in symbols:
            state, y = self.arcs[state, x]
            out.append(y)
        return out


def machine(start, symbols, step: Callable[[Any, int], tuple[Any, int]]) -> Machine:
    """The machine of all states that ``step`` (state, symbol -> state, symbol put
    out) leads to from ``start``."""
    names, arcs, todo = {start: 0}, {}, [start]
    while todo:
        state = todo.pop()
        for x in symbols:
            after, y = step(state, x)
            if after not in names:
                names[after] = len(names)
                todo.append(after)
            arcs[names[state], x] = (names[after], y)
    return Machine(arcs)


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that does what ``second`` does with what ``first`` puts out."""

    def step(state, x):
        p, mid = first.arcs[state[0], x]
        q, y = second.arcs[state[1], mid]
        return (p, q), y

    return machine((0, 0), sorted({x for _, x in first.arcs}), step)


def phrase_machine(phrases: list[list[int]], kind_of: dict[int, int]) -> Machine:
    """Each word as its kind, but the last word of a phrase as a threat. The state
    is the longest beginning of a phrase just read."""
    begins = {tuple(p[:i]) for p in phrases for i in range(len(p) + 1)}

    def step(state, x):
        read = (*state, x)
        whole = any(read[-len(p) :] == tuple(p) for p in phrases)
        while read not in begins:
            read = read[1:]
        return read, THREAT if whole else kind_of[x]

    return machine((), sorted(kind_of), step)


def _left(state: int) -> int:
    return max(state - 1, 0)


def _negated(left, x):
    if x == NEGATION:
        return REACH, OTHER
    return _left(left), {INSULT: DENIED, THREAT: OTHER}.get(x, x) if left else x


def _aimed(state, x):
    """state: words a target or modal still reaches, and which; words an insult
    or threat waits for its target, and which."""
    (near, what), (wait, which) = state
    calm = ((_left(near), what if near > 1 else 0), (_left(wait), which if wait > 1 else 0))
    if x == TARGET:
        return ((REACH, TARGET), (0, 0)), {INSULT: AIM, THREAT: THREATENED}.get(which if wait else 0, OTHER)
    if x == MODAL:
        return ((REACH, MODAL), calm[1]), OTHER
    if x == THREAT:
        return (calm, THREATENED) if near else ((calm[0], (REACH, THREAT)), OTHER)
    if x == INSULT:
        return (calm, AIMED) if near and what == TARGET else ((calm[0], (REACH, INSULT)), INSULT)
    return calm, x


def _quoted(state, x):
    if x == REPORT:
        return 1, OTHER
    return state, {INSULT: QUOTED, AIMED: QUOTED, AIM: OTHER, THREATENED: OTHER}.get(x, x) if state else x


_KINDS = range(7)
NEGATED = machine(0, _KINDS, _negated)
AIMING = machine(((0, 0), (0, 0)), [*_KINDS, DENIED], _aimed)
REPORTED = machine(0, range(12), _quoted)
#: Symbols of single words: the classes, then each word of a phrase.
_CLASSES = {w: k for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (MODAL, MODALS)) for w in ws}
_PHRASED = {w: 12 + i for i, w in enumerate(sorted({w for p in PHRASES for w in p.split()}))}
SYMBOL = _CLASSES | _PHRASED
_KIND_OF = {k: k for k in _KINDS} | {n: _CLASSES.get(w, OTHER) for w, n in _PHRASED.items()}
#: Symbols without which a clause scores nothing.
STARTERS = (INSULT, THREAT, *sorted({_PHRASED[p.split()[-1]] for p in PHRASES}), *sorted(n for n, k in _KIND_OF.items() if k == THREAT and n != THREAT))


@cache
def clause_machine() -> Machine:
    phrases = phrase_machine([[_PHRASED[w] for w in p.split()] for p in PHRASES], _KIND_OF)
    return compose(compose(compose(phrases, NEGATED), AIMING), REPORTED)


#: The lexicon alone, to measure what the grammar adds.
LEXICON_ALONE = Machine({(0, x): (0, k if k == INSULT else OTHER) for x, k in _KIND_OF.items()})


def normal(chunk: str) -> tuple[str, bool]:
    """The bare lower-case word of a chunk, and whether a clause ends behind it."""
    return _EDGE.sub("", chunk).lower(), chunk[-1:] in ".!?;:" if chunk else False


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)] if word else []


@dataclass
class Grammar:
    lexicon: dict[str, float]
    weights: np.ndarray | None = None  # of FEATURES, then the constant
    machine: Machine | None = None  # None: clause_machine()

    def __post_init__(self):
        self.memo: dict[str, tuple[int, float, bool, bool]] = {}
        self.heads = {f.rstrip("*")[: STEMS[0]] for f in self.lexicon}  # no other word has a weight

    def tag(self, chunk: str) -> tuple[int, float, bool, bool]:
        """Symbol, weight, clause end and clause begin of a chunk; words of the
        lexicon are insults before anything else."""
        out = self.memo.get(chunk)
        if out is None:
            word, ends = normal(chunk)
            weight = max(self.lexicon.get(f, 0.0) for f in features_of(word)) if word and word[: STEMS[0]] in self.heads else 0.0
            out = (INSULT if weight > 0 else SYMBOL.get(word, OTHER), weight, ends, word in CONJUNCTIONS)
            if len(self.memo) < MEMO:
                self.memo[chunk] = out
        return out

    def score(self, symbols: np.ndarray, weights: np.ndarray, clause: np.ndarray) -> list[float]:
        """FEATURES of one text, from its words' symbols, weights and clauses."""
        arcs = (self.machine or clause_machine()).arcs
        top = total = negated = reported = threats = 0.0
        clauses = 0
        for c in np.unique(clause[np.isin(symbols, STARTERS)]).tolist():
            lo, hi = np.searchsorted(clause, c, "left"), np.searchsorted(clause, c, "right")
            state, value = 0, 0.0
            for x, w in zip(symbols[lo:hi].tolist(), weights[lo:hi].tolist(), strict=True):
                state, y = arcs[state, x]
                if y:
                    value += FACTOR.get(y, 0.0) * w + EXTRA.get(y, 0.0)
                    negated += w * (y == DENIED)
                    reported += w * (y == QUOTED)
                    threats += y == THREATENED
            clauses += value > 0
            top, total = max(top, value), total + value
        return [min(top, 10.0), np.log1p(total), np.log1p(clauses), np.log1p(negated), np.log1p(reported), np.log1p(threats)]

    def read(self, texts: pa.Array) -> np.ndarray:
        """FEATURES of a batch of texts; those without a word of the insult or
        threat classes or the end of a phrase are not gone through."""
        offsets, codes, words = chunks(texts)
        memo = self.memo
        table = [memo.get(w) or self.tag(w) for w in words]
        symbols = np.array([t[0] for t in table], dtype=np.int16)
        weights = np.array([t[1] for t in table])
        ends, begins = (np.array([t[i] for t in table], dtype=np.int64) for i in (2, 3))
        out = np.zeros((len(offsets) - 1, len(FEATURES)))
        if not len(codes):
            return out
        hit = np.concatenate([[0], np.cumsum(np.isin(symbols, STARTERS)[codes])])
        for i in np.flatnonzero(hit[offsets[1:]] > hit[offsets[:-1]]).tolist():
            c = codes[offsets[i] : offsets[i + 1]]
            clause = np.cumsum(ends[c] + begins[c]) - ends[c]
            out[i] = self.score(symbols[c], weights[c], clause)
        return out

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Newton's method with a small ridge, rows counting ``times``; constant last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (times * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


@lean
def _document_counts(batches):
    """(feature, toxic, n): documents that have a word or stem."""
    held: dict[tuple[str, int], int] = {}
    for b in batches:
        if not b.num_rows:
            continue
        offsets, codes, words = chunks(b.column("text"))
        forms = [normal(w)[0] for w in words]
        names, index, rows = {}, [], []
        for i, word in enumerate(forms):
            for f in features_of(word):
                index.append(names.setdefault(f, len(names)))
                rows.append(i)
        if not names:
            continue
        index, rows = np.array(index), np.array(rows)
        first, n_of = np.searchsorted(rows, np.arange(len(words))), np.bincount(rows, minlength=len(words))
        toxic, times = b.column("toxic").to_numpy(), b.column("times").to_numpy()
        doc = np.repeat(np.arange(b.num_rows), np.diff(offsets))
        pair = np.unique(doc * len(words) + codes)
        doc, code = pair // len(words), pair % len(words)
        n = n_of[code]
        begin = np.repeat(first[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair = np.unique(np.repeat(doc, n) * len(names) + index[begin])
        doc, f = pair // len(names), pair % len(names)
        labels = list(names)
        for k in (0, 1):
            mine = toxic[doc] == k
            count = np.bincount(f[mine], weights=times[doc[mine]], minlength=len(names))
            for i in np.flatnonzero(count).tolist():
                held[(labels[i], k)] = held.get((labels[i], k), 0) + int(count[i])
        if len(held) > 150_000:
            yield _counts(held)
            held = {}
    if held:
        yield _counts(held)


def _counts(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "feature": pa.array([k[0] for k in held], pa.string()),
            "toxic": pa.array([k[1] for k in held], pa.int32()),
            "n": pa.array(list(held.values()), pa.int64()),
        }
    )


def _marks(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, times, fold): labels that may teach; an id may be labelled
    any number of times."""
    named = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    return named.groupBy("doc_id", "toxic").agg(F.count("*").alias("times")).withColumn("fold", crc_fold(F.col("doc_id"))).where("fold <> 2")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _some(marks: DataFrame, most: int) -> DataFrame:
    """At most about ``most`` of the rows, by id hash."""
    share = min(1_000_000, int(most * 1e6 / max(marks.count(), 1)))
    return marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)


def fit(docs: DataFrame, labels: DataFrame, least: int = 4, share: float = 0.005, odds: float = 12.0, machine: Machine | None = None) -> Grammar:
    """Learn from labelled documents whose crc32(doc_id as text) mod 4 is not 2.

    At most ``LABELLED`` labelled ids (a share by id hash) teach, so that they reach
    the texts as a broadcast of bounded size and no text is shuffled. The lexicon
    comes from document counts over all of these but the fold 3: a word or stem in
    at least ``least`` toxic documents (and the share ``share`` of them, which
    bounds the lexicon by a document's mean number of words and stems over the
    share) and ``odds`` times likelier there (half that, if 3 % of the toxic
    documents have it). The probability map is fitted on at most ``FIT_ROWS`` ids
    of the fold 3. Rows with a null label or id and labels without a document teach
    nothing; a document labelled twice, or an id on two texts, teaches twice.
    Without labels or documents the lexicon is empty and every text scores alike.
    """
    tune(docs.sparkSession)
    marks, rows = _some(_marks(labels), LABELLED), _texts(docs)
    taught = rows.join(F.broadcast(marks.where("fold <> 3")), "doc_id")
    n = {r["toxic"]: r["n"] for r in marks.where("fold <> 3").groupBy("toxic").agg(F.sum("times").alias("n")).collect()}
    bad, good = max(n.get(1, 0), 1), max(n.get(0, 0), 1)
    counts = taught.select("text", "toxic", "times").mapInArrow(_document_counts, "feature string, toxic int, n long")
    counts = counts.groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good")
    )
    ratio = ((F.col("bad") + 0.5) / bad) / ((F.col("good") + 0.5) / good)
    found = counts.where(F.col("bad") >= max(least, share * bad)).withColumn("ratio", ratio)
    found = found.where((F.col("ratio") >= odds) | ((F.col("ratio") >= odds / 2) & (F.col("bad") >= 0.03 * bad)))
    grammar = Grammar({r["feature"]: float(min(np.log(r["ratio"]) / 3, 2.5)) for r in found.select("feature", "ratio").collect()}, machine=machine)
    return fit_map(docs, labels, grammar)


def fit_map(docs: DataFrame, labels: DataFrame, grammar: Grammar) -> Grammar:
    """The grammar with its probability map, fitted on the labelled fold 3."""
    rows, chosen = _texts(docs), _some(_marks(labels).where("fold = 3"), FIT_ROWS)
    held = docs.sparkSession.sparkContext.broadcast(grammar)

    @lean
    def features(batches):
        for b in batches:
            x = pa.array(held.value.read(b.column("text")).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict({"y": b.column("toxic"), "times": b.column("times"), "x": x})

    fitted = rows.join(F.broadcast(chosen), "doc_id").select("toxic", "times", "text").mapInArrow(features, "y int, times long, x array<double>").toPandas()
    held.destroy()
    if len(fitted):
        grammar.weights = logistic(np.array(fitted["x"].tolist()), (fitted["y"].to_numpy() > 0).astype(float), fitted["times"].to_numpy(float))
    else:
        grammar.weights = np.array([1.0, 0, 0, 0, 0, 0, -2.0])
    return grammar


def predict(docs: DataFrame, grammar: Grammar, keep: list[Column], threshold: float = 0.3) -> DataFrame:
    """``keep`` columns, score (0 to 1) and predicted (1 if score >= threshold).

    Null, empty and wordless texts have no clause to match and get the score of
    a text without matches. Repeated rows are judged one by one; an empty table
    gives no rows. ``keep`` may not bring a column named score or predicted.
    """
    held = tune(docs.sparkSession).sparkContext.broadcast(grammar)
    rows = docs.select(F.struct(*keep).alias("kept"), F.col("text").cast("string").alias("text"))
    if clash := {"score", "predicted"} & set(rows.select("kept.*").columns):
        raise ValueError(f"keep may not bring {sorted(clash)}")

    @lean
    def run(batches):
        for b in batches:
            score = held.value.probability(held.value.read(b.column("text")))
            out = {"kept": b.column("kept"), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, score double, predicted int").select("kept.*", "score", "predicted")
