"""Toxicity: a weighted finite-state pattern grammar.

A text's words become symbols: insult, threat, target, negation, reported speech, clause end (``.!?;`` or a line end); all else is
skipped but counted. Small transducers each read the symbols: insults, targets, threats near who they are for, a negation just before, a
report around. They are composed into one machine by the product construction: a clause counts if it aims an insult or threat at someone, if it insults
twice, or once where an aimed clause or two insults are not far back. A clause that the machine doesn't accept scores nothing, whatever words it holds: neither ``a fool`` alone
nor ``the burn of wood`` do. The scores of the matched clauses make the document's by a logistic curve.

The insult lexicon is a short fixed list plus words and stems learned from labelled documents: those that toxic ones hold
far more often than chance allows. It is learned from at most ``max_train`` documents, chosen by a hash of their id;
counts go through an aggregation, and at most ``max_terms`` terms are kept, so the broadcast machine has a fixed size.

Defined cases: null or empty text: no symbol, the lowest score. Very long texts are read whole. Null doc_id: not held out, never in the
sample. Without labels, or without documents of both kinds, the fixed lists and curve are used. Ties among terms go by the term, repeated
labels of a document by the largest. Repeated rows give repeated results. Other columns, whatever their names, are left out. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, store
from .quality_knn import SCORES, sample

# Word lists of the grammar.
INSULTS = "idiot moron stupid loser scum trash clown pathetic worthless disgusting imbecile fool dumb bastard dummkopf trottel abschaum widerlich versager connard imbécile ordure minable dégoûtant idiota imbécil basura asqueroso estúpido".split()
THREATS = "kill hurt destroy attack burn töten vernichten verletzen tuer détruire frapper matar destruir golpear".split()
TARGETS = "you your they them those these people du dich ihr euch sie leute tu toi vous ils gens tú usted ellos gente".split()
NEGATIONS = "not never no isn't aren't don't nicht kein keine nie ne jamais pas nunca ningún".split()
REPORTS = "said says wrote called quoted claimed sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
STEMS = (4, 5, 6, 7)
_STRIP = ".,;:!?\"'()[]{}*#$%&|<>«»„“”…-"
_ENDS = ".!?;"


class Transducer:
    """States 0..n-1, start 0. step: (state, symbol) -> (state, factor on the weight of an insult or threat read here).

    A clause counts if it ends in a state of ``accept``; a transducer without such only weighs.
    """

    def __init__(self, states: int, step: dict[tuple[int, int], tuple[int, float]], accept: set[int] | None = None) -> None:
        self.states = states
        self.step = step
        self.accept = set(range(states)) if accept is None else accept

    def __call__(self, state: int, symbol: int) -> tuple[int, float]:
        return self.step.get((state, symbol), (state, 1.0))

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols side by side; factors multiply, both must accept."""
        step = {}
        for a, b, s in product(range(self.states), range(other.states), range(7)):
            (x, f), (y, g) = self(a, s), other(b, s)
            step[a * other.states + b, s] = (x * other.states + y, f * g)
        accept = {a * other.states + b for a, b in product(range(self.states), range(other.states)) if a in self.accept and b in other.accept}
        return Transducer(self.states * other.states, step, accept)


def insults(most: int = 3) -> Transducer:
    """Counts a clause's insults, up to ``most``; accepts clauses with one."""
    step = {(q, INSULT): (min(most, q + 1), 1.0) for q in range(most + 1)} | {(q, END): (0, 1.0) for q in range(most + 1)}
    return Transducer(most + 1, step, set(range(1, most + 1)))


def targets(factor: float = 1.5) -> Transducer:
    """Accepts clauses that name someone; an insult or threat after that weighs more."""
    return Transducer(2, {(0, TARGET): (1, 1.0), (1, INSULT): (1, factor), (1, THREAT): (1, factor), (1, END): (0, 1.0)}, {1})


def threats(reach: int = 4) -> Transducer:
    """Accepts clauses with a threat at most ``reach`` words before or behind who it is for."""
    done = 2 * reach + 1  # 1..reach: words left since a threat, reach+1..2*reach: since a target
    step: dict[tuple[int, int], tuple[int, float]] = {(q, END): (0, 1.0) for q in range(done + 1)}
    for q in range(done):
        since_threat, since_target = 1 <= q <= reach, reach < q
        fewer = 0 if q in (0, 1, reach + 1) else q - 1
        step |= {(q, s): (fewer, 1.0) for s in (OTHER, INSULT, NEGATION, REPORT)}
        step[q, THREAT] = (done if since_target else reach, 1.0)
        step[q, TARGET] = (done if since_threat else 2 * reach, 1.0)
    return Transducer(done + 1, step, {done})


def abuse(insult: Transducer, target: Transducer, threat: Transducer, reach: int = 20, enough: int = 3) -> Transducer:
    """Accepts clauses that aim an insult or a threat at someone, and insults that go on with it or with others.

    What came before is remembered for ``reach`` clauses: an aimed clause, or how many insults. A clause that names no one counts if it insults twice, behind an
    aimed one, or if it makes ``enough`` insults together with those before. Insult, target and threat read the clause side by side.
    """
    known = [(0, 0), *((level, left) for level in range(1, enough) for left in range(1, reach + 1))]  # insults so far and clauses left; the last level also stands for an aimed clause
    number = {k: n for n, k in enumerate(known)}
    place = lambda k, i, t, h: ((number[k] * insult.states + i) * target.states + t) * threat.states + h
    step, accept = {}, set()
    for (level, left), i, t, h in product(known, range(insult.states), range(target.states), range(threat.states)):
        aimed = (i in insult.accept and t in target.accept) or h in threat.accept
        here = place((level, left), i, t, h)
        if aimed or i > 1 or (i and level + i >= enough):
            accept.add(here)
        total = enough - 1 if aimed else min(enough - 1, level + i)
        then = (total, reach) if total and (aimed or i) else (level, left - 1) if left > 1 else (0, 0)
        for s in range(7):
            (x, f), (y, g), (z, e) = insult(i, s), target(t, s), threat(h, s)
            step[here, s] = (place(then if s == END else (level, left), x, y, z), f * g * e)
    return Transducer(len(known) * insult.states * target.states * threat.states, step, accept)


def negation(reach: int = 3, factor: float = 0.5) -> Transducer:
    """An insult within ``reach`` words of a negation weighs less."""
    step = {(q, NEGATION): (reach, 1.0) for q in range(reach + 1)} | {(q, END): (0, 1.0) for q in range(reach + 1)}
    for q in range(1, reach + 1):
        step |= {(q, s): (q - 1, factor if s in (INSULT, THREAT) else 1.0) for s in (OTHER, TARGET, REPORT, INSULT, THREAT)}
    return Transducer(reach + 1, step)


def report(factor: float = 0.6) -> Transducer:
    """What is said to have been said weighs less, to the end of its clause."""
    return Transducer(2, {(0, REPORT): (1, 1.0), (1, INSULT): (1, factor), (1, THREAT): (1, factor), (1, END): (0, 1.0)})


@cache
def grammar() -> Transducer:
    return abuse(insults(), targets(), threats()).compose(negation()).compose(report())


class Machine:
    """The composed grammar with a lexicon: word or stem -> weight."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], curve: tuple[float, float, float] = (-3.0, 2.5, 0.0)) -> None:
        self.words, self.stems, self.curve = words, stems, curve
        self.grammar = grammar()
        self.fixed = {w: s for s, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.seen: dict[str, tuple[int, float, bool]] = {}

    def symbol(self, token: str) -> tuple[int, float, bool]:
        """(symbol, weight, whether the clause ends here) of a blank-separated token."""
        if token == "\n":
            return OTHER, 0.0, True
        w = token.lower().strip(_STRIP)
        ends = token[-1:] in _ENDS
        weight = max([self.words.get(w, 0.0), *(self.stems.get(w[:k], 0.0) for k in STEMS if len(w) >= k)])
        if weight:
            return INSULT, weight, ends
        s = self.fixed.get(w, OTHER)
        return s, 0.6 if s == THREAT else 0.0, ends

    def clauses(self, text: str) -> tuple[list[float], int]:
        """Scores of the matched clauses, which end at ``.!?;`` and at line ends, and the number of words."""
        tokens = [t for line in text.split("\n") for t in (*line.split(), "\n")]
        seen, lines = self.seen, text.count("\n") + 1
        found = list(map(seen.get, tokens))
        if None in found:
            if len(seen) > 300_000:
                seen.clear()
            for i, x in enumerate(found):
                if x is None:
                    found[i] = x = self.symbol(tokens[i])
                    if len(tokens[i]) < 40:
                        seen[tokens[i]] = x
        if not any(x[1] for x in found):
            return [], len(tokens) - lines
        out, state, score = [], 0, 0.0
        step, accept = self.grammar.step, self.grammar.accept
        for s, weight, ends in found:
            state, factor = step[state, s]
            score += weight * factor
            if ends:
                if score and state in accept:
                    out.append(score)
                state, score = step[state, END][0], 0.0
        if score and state in accept:
            out.append(score)
        return out, len(tokens) - lines

    def inputs(self, text: str | None) -> tuple[float, float]:
        """The curve's inputs: all clauses' score, and its density."""
        found, n = self.clauses(text or "")
        total = sum(found)
        return math.log1p(total), 100 * total / (n + 20)

    def score(self, text: str | None) -> float:
        a, b, c = self.curve
        x, y = self.inputs(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))

    def __getstate__(self) -> tuple:
        return self.words, self.stems, self.curve

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)


def terms(text: str | None) -> tuple[dict[str, int], int]:
    """Words of a text ("w:") and their stems ("s:"), with how many different words have the stem; the number of different words."""
    words = {t.strip(_STRIP) for t in (text or "").lower().split()} - {""}
    out = {"w:" + w: 1 for w in words}
    for k in STEMS:
        out |= Counter("s:" + w[:k] for w in words if len(w) > k)
    return out, len(words)


def signature(text: str | None) -> int:
    """Least hash of the three-word shingles: nearly always the same for near copies."""
    import xxhash

    words = (text or "").split()
    return min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 3])) >> 1 for i in range(max(1, len(words) - 2))), default=0)


def _gain(pos: int, neg: int, npos: int, nneg: int) -> float:
    """One-sided G statistic of a term's counts among toxic and other documents' words."""
    n, k = npos + nneg, pos + neg
    if not npos or not nneg or pos * n <= k * npos:
        return 0.0
    return 2 * sum(o * math.log(o / e) for o, e in ((pos, k * npos / n), (neg, k * nneg / n)) if o and e)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, part: int = 2, max_train: int = 8000, max_terms: int = 4000, least_gain: float = 24.0, least_docs: int = 3) -> Machine:
    """The machine with its lexicon and curve from a bounded sample of labelled documents, near copies counted once.

    A term counts once for each document, a stem once for each different word with it; it becomes an insult if the toxic
    documents have it beyond chance (``least_gain`` of the G statistic) in ``least_docs`` documents at least.
    """
    small_batches(docs.sparkSession)
    drawn = sample(docs, labels, label, parts, part, max_train).select(F.col("text").cast("string").alias("text"), F.col("y").cast("int").alias("y"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("text"), b.column("y"), pa.array([signature(t) for t in b.column("text").to_pylist()], pa.int64())], ["text", "y", "sig"])

    rows, _ = store(drawn.mapInArrow(signed, "text string, y int, sig long").groupBy("sig", "y").agg(F.min("text").alias("text")).select("text", "y"), "toxic-sample")
    words = dict.fromkeys(INSULTS, 1.0)
    stems: dict[str, float] = {}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = []
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                got, n = terms(text)
                flat += [(t, y, k) for t, k in got.items()]
                flat.append(("", y, n))
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in flat], kind) for j, kind in enumerate((pa.string(), pa.int32(), pa.int64()))], ["t", "y", "k"])

    toxic = F.col("y") == 1
    counts, _ = store(rows.mapInArrow(found, "t string, y int, k long").groupBy("t").agg(F.sum(F.when(toxic, F.col("k")).otherwise(0)).alias("pos"), F.sum(F.when(toxic, 0).otherwise(F.col("k"))).alias("neg"), F.count(F.when(toxic, 1)).alias("docs"), F.count(F.when(~toxic, 1)).alias("others")), "toxic-terms")
    every = counts.where("t = ''").first()
    if every is None or not every.pos or not every.neg:
        return Machine(words, stems)
    odds = every.neg / every.pos
    likely = counts.where((F.col("t") != "") & (F.col("docs") >= least_docs) & (F.col("pos") * odds > 6 * F.col("neg"))).orderBy(F.desc(F.col("pos") - F.col("neg") / odds), "t").limit(max_terms).collect()
    for r in likely:
        if _gain(r.pos, r.neg, every.pos, every.neg) >= least_gain:
            weight = min(2.0, math.log((r.pos + 0.5) * odds / (r.neg + 0.5)) / 3)
            (words if r.t[0] == "w" else stems)[r.t[2:]] = weight
    machine = Machine(words, stems)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = [m.inputs(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), b.column("y")], ["a", "b", "y"])

    got = rows.mapInArrow(inputs, "a double, b double, y int").collect()  # max_train rows of three numbers
    machine.curve = _logistic(np.array([[1.0, r.a, r.b] for r in got]), np.array([r.y for r in got], float))
    return machine


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 50) -> tuple[float, float, float]:
    """Regularised logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1e-3, 1.0, 1.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1]), float(w[2])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) for each document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(machine)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = [m.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(rows, SCORES)
