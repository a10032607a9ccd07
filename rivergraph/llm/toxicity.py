"""Toxicity by a weighted finite-state pattern grammar.

Each word becomes a symbol: insult, threat, target, negation, report, clause end or plain word. Four transducers read the
symbols of a clause. Negation and reported speech rewrite the insults and threats in their scope. The insult transducer
marks the clause's end: aimed (an insult and a target, in either order), bare (an insult alone), or off (only negated or
reported ones). The threat transducer marks it if a threat and a target are in the clause; a threat alone is a plain word.
Their composition is one table that reads a text once. What a text scores is the sum over its matched clauses by mark, a
clause weighing as much as its insults together, under a logistic model; words count only through their clause.

Insults are learned: words and word beginnings that stand in toxic documents far more often than in others, counted over
a sample of labelled rows and then, for the candidates, over distinct neighbouring words, so that copies of one document
don't vote twice. The sample is the `SAMPLE` labelled rows of smallest hash; that bound is a parameter, and every document
is scored. A term is in the lexicon if it is significant, whatever their number. Threats, targets, negations and reports
are word lists below.

Only the text is scored: labels serve for fitting, and of them only rows whose crc32(doc_id as text) mod 3 is not 1.

Defined cases: null and empty texts get the score of a text without matches; rows that repeat a doc_id give a row each
(their labels: the highest counts); without labels of both kinds nothing is learned and every score is 0; an empty table
gives an empty result; further columns are ignored, and drop_toxic keeps them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, stored, table

SAMPLE = 12_000
THRESHOLD = 0.7
PREFIXES = (3, 4, 5, 6, 7, 8)

#: Words of the closed classes, in English, French, German and Spanish.
THREATS = frozenset("kill hurt destroy murder burn shoot stab beat crush hang tuer frapper détruire brûler töten schlagen zerstören verbrennen matar golpear destruir quemar".split())
TARGETS = frozenset("you your yours yourself u he him she her they them tu toi te vous vos il elle ils elles du dich dir ihr euch sie er tú ti usted ustedes él ella ellos ellas".split())
NEGATIONS = frozenset("not no never neither nor without isn aren don doesn didn won ne pas jamais sans ni nicht nie kein keine keinen ohne nunca jamás sin".split())
REPORTS = frozenset("said says say saying told claimed claims wrote writes quoted quote called according dit disait écrit selon sagte sagt schrieb laut dijo dice según escribió".split())

WORD, END, NEG, REPORT, TARGET, THREAT, INSULT = range(7)
INSULT_OFF, THREAT_OFF = 7, 8
#: Marks of a clause's end: what its insults are, and, from BARE + 4 on, the same with a threat. END itself is without both.
OFF, BARE, AIMED, MENACE = 9, 10, 11, 12
SYMBOLS = 16
NEG_SCOPE = 3
_TOKEN = re.compile(r"\w+|[.!?;:\n\"«»“”]")
_ENDS = (END, OFF, BARE, AIMED)


class Transducer(NamedTuple):
    """step[state][symbol] = (next state, output symbol); state 0 begins."""

    step: tuple[tuple[tuple[int, int], ...], ...]

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what this one writes."""
        n = len(other.step)
        return Transducer(
            tuple(
                tuple((p2 * n + q2, out) for s in range(SYMBOLS) for p2, mid in [self.step[p][s]] for q2, out in [other.step[q][mid]])
                for p in range(len(self.step))
                for q in range(n)
            )
        )


def _machine(states: int, move) -> Transducer:
    return Transducer(tuple(tuple(move(q, s) for s in range(SYMBOLS)) for q in range(states)))


_TURN = {INSULT: INSULT_OFF, THREAT: THREAT_OFF}


def negation(scope: int = NEG_SCOPE) -> Transducer:
    """Insults and threats within `scope` words after a negation, in its clause, are off."""

    def move(left: int, s: int) -> tuple[int, int]:
        if s in (END, NEG):
            return (scope if s == NEG else 0), s
        return max(0, left - 1), _TURN.get(s, s) if left else s

    return _machine(scope + 1, move)


def reported() -> Transducer:
    """After a verb of saying, what is left of the clause is someone else's."""
    return _machine(2, lambda q, s: (0 if s == END else 1 if s == REPORT else q, _TURN.get(s, s) if q else s))


def insulting() -> Transducer:
    """Marks ends of clauses with insults. State: whether a target was seen, and 0, 1 (insults that are off) or 2 (others)."""

    def move(q: int, s: int) -> tuple[int, int]:
        target, found = q % 2, q // 2
        if s == END:
            return 0, (END, OFF, AIMED if target else BARE)[found]
        target, found = target or int(s == TARGET), max(found, {INSULT: 2, INSULT_OFF: 1}.get(s, 0))
        return target + 2 * found, s

    return _machine(6, move)


def threatening() -> Transducer:
    """Adds to the mark of a clause that it holds a threat and a target. State: whether each was seen."""

    def move(q: int, s: int) -> tuple[int, int]:
        if s in _ENDS:
            return 0, MENACE + _ENDS.index(s) if q == 3 else s
        return q | int(s == TARGET) | 2 * int(s == THREAT), s

    return _machine(4, move)


MACHINES = (negation(), reported(), insulting(), threatening())
GRAMMAR = MACHINES[0].then(MACHINES[1]).then(MACHINES[2]).then(MACHINES[3])

FEATURES = ("insulting", "aimed", "off", "menacing", "distinct", "clauses", "per_word")


def classify(word: str, lexicon: dict[str, float]) -> tuple[int, float]:
    """The symbol of a lower-cased token, and the weight of an insult: its word's, or its heaviest beginning's."""
    weight = max([lexicon.get(word + "$", 0.0), *(lexicon.get(word[:k], 0.0) for k in PREFIXES if len(word) > k)])
    if weight > 0:
        return INSULT, weight
    if len(word) == 1 and not word.isalnum() and word != "_":
        return END, 0.0
    for symbol, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEG, NEGATIONS), (REPORT, REPORTS)):
        if word in words:
            return symbol, 0.0
    return WORD, 0.0


class _Classes(dict):
    """token -> (symbol, weight), filled as tokens come; bounded."""

    def __init__(self, lexicon: dict[str, float], most: int = 100_000):
        self.lexicon, self.most = lexicon, most

    def __missing__(self, token: str) -> tuple[int, float]:
        if len(self) >= self.most:
            self.clear()
        found = self[token] = classify(token, self.lexicon)
        return found


def clauses(text: str, classes: _Classes) -> tuple[list[tuple[int, float]], int, int]:
    """(mark, weight) of each matched clause, how many tokens there are, and how many different insults in matched ones. A
    clause weighs as much as its insults, 1 if it holds none."""
    tokens = _TOKEN.findall(text.lower())
    found = [classes[t] for t in tokens]
    if not any(s >= THREAT for s, _ in found):
        return [], 0, 0
    out: list[tuple[int, float]] = []
    step, state, total, here, seen = GRAMMAR.step, 0, 0.0, set(), set()
    for token, (symbol, weight) in zip([*tokens, "."], [*found, (END, 0.0)], strict=True):
        state, mark = step[state][symbol]
        if weight:
            total += weight
            here.add(token)
        elif symbol == END:
            if mark != END:
                out.append((mark, total or 1.0))
                seen |= here
            total, here = 0.0, set()
    return out, len(tokens), len(seen)


def features(text: str, classes: _Classes) -> list[float]:
    found, count, distinct = clauses(text, classes)
    if not found:
        return [0.0] * len(FEATURES)
    of = lambda *marks: sum(w for m, w in found if m in marks)
    strong = of(BARE, AIMED, MENACE + 2, MENACE + 3)
    values = (strong, of(AIMED, MENACE + 3), of(OFF, MENACE + 1), of(MENACE, MENACE + 1, MENACE + 2, MENACE + 3), distinct, len(found), 100 * strong / count)
    return [math.log1p(x) for x in values]


class Model(NamedTuple):
    lexicon: dict[str, float]
    weights: np.ndarray | None  # bias first; None: nothing learned

    def score(self, values: list[float]) -> float:
        if self.weights is None:
            return 0.0
        z = float(self.weights[0] + self.weights[1:] @ np.asarray(values))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def _terms(token: str) -> list[str]:
    return [token + "$", *(token[:k] for k in PREFIXES if len(token) > k)]


def _counted(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """term, pos, neg: documents by label, added up as far as `most` terms."""
    counts: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([v[0] for v in counts.values()], pa.int64()),
            pa.array([v[1] for v in counts.values()], pa.int64())], names=["term", "pos", "neg"])

    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
            for term in {t for w in set(_TOKEN.findall(text.lower())) if w[0].isalpha() for t in _terms(w)}:
                counts.setdefault(term, [0, 0])[0 if label else 1] += 1
            if len(counts) > most:
                yield out()
                counts = {}
    if counts:
        yield out()


def _contexts(terms: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("term", pa.string()), ("context", pa.string()), ("label", pa.int32())])
        rows: set[tuple] = set()
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                tokens = _TOKEN.findall(text.lower())
                for before, w in zip(["", *tokens], tokens, strict=False):
                    rows.update((t, f"{before} {w}", label) for t in _terms(w) if t in terms)
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                    rows = set()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return run


def _ratio(pos: Column, neg: Column, n_pos: float, n_neg: float) -> Column:
    return (pos / F.lit(float(n_pos))) / ((neg + 0.5) / F.lit(float(n_neg)))


def learn_lexicon(sample: DataFrame, n_pos: int, n_neg: int) -> dict[str, float]:
    """Terms with their weights from sample (text, label)."""
    share = n_pos / (n_pos + n_neg)
    counts = sample.mapInArrow(lean(_counted), "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    expected = (F.col("pos") + F.col("neg")) * F.lit(share)
    unlikely = (F.col("pos") - expected) / F.sqrt(expected * F.lit(1 - share))
    good = counts.where((F.col("pos") >= max(4, n_pos // 200)) & (_ratio(F.col("pos"), F.col("neg"), n_pos, n_neg) >= 4) & (unlikely >= 5))
    top = {r["term"] for r in good.select("term").collect()}
    if not top:
        return {}
    seen = sample.mapInArrow(lean(_contexts(top)), "term string, context string, label int").groupBy("term", "context").agg(F.max("label").alias("label"))
    per = seen.groupBy("term").agg(F.sum("label").alias("pos"), F.count("*").alias("n")).collect()
    lexicon = {}
    for term, pos, n in per:
        ratio = (pos / n_pos) / ((n - pos + 0.5) / n_neg)
        if pos >= max(4, n_pos // 100) and ratio >= 4 and (pos - n * share) / math.sqrt(n * share * (1 - share)) >= 5:
            lexicon[term] = min(math.log(ratio), 4.0)
    return lexicon


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Weights, bias first, by Newton steps with a ridge penalty on all but the bias."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.0] + [penalty] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(len(w)), x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _featured(lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes(lexicon)
        for b in batches:
            rows = [features(t, classes) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column("label")], names=["x", "label"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE) -> Model:
    """Learn from at most sample_rows labelled rows that are not held out; only counts, the lexicon and a few numbers a
    sampled row reach the driver."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    ids = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    base = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = stored(base.join(F.broadcast(ids), F.col("_doc") == F.col("_id")).select("text", "label").distinct())
    n = dict(sample.groupBy("label").count().collect())
    if not n.get(0) or not n.get(1):
        return Model({}, None)
    lexicon = learn_lexicon(sample, n[1], n[0])
    rows = sample.mapInArrow(lean(_featured(lexicon)), "x array<double>, label int").collect()
    return Model(lexicon, fit_logistic(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float)))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score, matches (the features)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes(model.lexicon)
        for b in batches:
            rows = [features(t, classes) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([model.score(r) for r in rows], pa.float64()),
                pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "score", "matches"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(lean(run), "doc_id long, score double, matches array<double>")


def drop_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without rows that score the threshold or more; columns and other rows as they are."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes(model.lexicon)
        for b in batches:
            yield b.filter(pa.array([model.score(features(t or "", classes)) < threshold for t in b.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
