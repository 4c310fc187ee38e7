"""Toxicity from a learned lexicon, misspellings included, in context windows.

Terms and stems that mark toxic rows are learned from labelled rows. A
document's words run through Levenshtein automata intersected with the
lexicon's trie. Hits inside quotation marks count apart from those in plain
text, and the densest window of plain hits counts on its own, so quoting an
insult differs from hurling it; a small logistic model weighs these measures.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import done, small_batches, whole_text, written
from .fuzzy import Lexicon

#: Labelled rows that the model is fitted on, about; with more, a hash of doc_id chooses.
MAX_TRAINING_ROWS = 20_000
#: A term must be in this share of the toxic rows (3 at least), so many times likelier there, and no accident.
LEAST_SHARE, LEAST_RATIO, MOST_CHANCE = 0.01, 10.0, 1e-4
STEM_LENGTHS = (4, 5, 6)
#: Words before and after a hit that make its window; a misspelled hit counts for this much.
WINDOW, FUZZY_WORTH = 8, 0.6
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W_]+")
#: Quotations end with their line; none holds its own opening mark, so the search is linear.
_QUOTED = re.compile(r'"[^"\n]+"|“[^“”\n]+”|«[^«»\n]+»|„[^„“”\n]+[“”]|‘[^‘’\n]+’')
#: Before any row is seen: intercept, plain hits, quoted hits, densest window, hits per word.
PRIOR = np.array([-3.0, 1.5, 0.2, 1.0, 0.5])


#: Words whose worth a process remembers.
MEMO_WORDS = 200_000
_BUILT: dict[bytes, Lexicon] = {}


def _built(terms: dict[str, float], stems: dict[str, float]) -> Lexicon:
    """This process's automaton of a lexicon: a worker's tasks share it, with all that they have determinised."""
    key = hashlib.sha256(repr((sorted(terms), sorted(stems))).encode("utf-8", "surrogatepass")).digest()
    if key not in _BUILT:
        if len(_BUILT) >= 2:
            _BUILT.clear()
        _BUILT[key] = Lexicon(terms, stems)
    return _BUILT[key]


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    harmless: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=PRIOR.copy)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("lexicon", "memo")}

    def worths(self, words: set[str]) -> dict[str, float]:
        """The words that match, with their worth."""
        memo = self.__dict__.setdefault("memo", {})
        if len(memo) > MEMO_WORDS:
            memo.clear()
        out = {}
        for w in words:
            x = memo.get(w)
            if x is None:
                x = self.hit(w)
                if len(w) <= 48:
                    memo[w] = x
            if x:
                out[w] = x
        return out

    def hit(self, word: str) -> float:
        """The worth of a word: 0 without a match, less for a misspelling; words of clean rows are no misspellings."""
        if "lexicon" not in self.__dict__:
            self.lexicon = _built(self.terms, self.stems)
        found = self.lexicon.match(word)
        if not found:
            return 0.0
        term, errors = found
        if errors and word in self.harmless:
            return 0.0
        return (self.stems.get(term) or self.terms[term]) * FUZZY_WORTH**errors

    def measures(self, text: str) -> list[float]:
        low = text.lower()
        worth = self.worths(set(_WORD.findall(low)))
        if not worth:
            return [1.0, 0.0, 0.0, 0.0, 0.0]
        quotes = [m.span() for m in _QUOTED.finditer(low)]
        plain, quoted, at, n, q = [], 0.0, [], 0, 0
        for n, m in enumerate(_WORD.finditer(low)):
            if x := worth.get(m[0]):
                while q < len(quotes) and quotes[q][1] <= m.start():
                    q += 1
                if q < len(quotes) and quotes[q][0] < m.start():
                    quoted += x
                else:
                    plain.append(x)
                    at.append(n)
        dense, a, inside = 0.0, 0, 0.0
        for b, x in enumerate(plain):
            inside += x
            while at[b] - at[a] > WINDOW:
                inside -= plain[a]
                a += 1
            dense = max(dense, inside)
        total = sum(plain)
        return [1.0, math.log1p(total), math.log1p(quoted), math.log1p(dense), math.log1p(100 * total / (n + 1))]

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-float(np.clip(np.dot(self.weights, self.measures(text)), -30, 30))))


def held_out(key: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _chance(a: int, mean: float) -> float:
    """Probability of ``a`` or more in a Poisson variable, summed in logarithms; 1 where ``a`` is no more than the mean."""
    if a <= mean or mean <= 0:
        return 1.0 if a <= mean else 0.0
    total, term, i = 0.0, 1.0, a
    while term > 1e-12 * total:  # in units of the first term
        total += term
        i += 1
        term *= mean / i
    return math.exp(min(0.0, a * math.log(mean) - mean - math.lgamma(a + 1) + math.log(total)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (feature, toxic rows, clean rows): words, and their beginnings with a mark in front."""
    for batch in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(_WORD.findall(text.lower()))
            seen[toxic].update(words)
            seen[toxic].update({f"\x00{w[:k]}" for w in words for k in STEM_LENGTHS if len(w) > k})
        names = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()), pa.array([seen[0][x] for x in names], pa.int64())],
            names=["feature", "toxic", "clean"],
        )


def _lexicon(counts: DataFrame, toxic: int, clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that mark toxic rows, with their worth.

    Each is in a share of the toxic rows, so they number at most what such a
    row holds on average, divided by that share, whatever the size of the input.
    """
    least = max(3, math.ceil(LEAST_SHARE * toxic))
    ratio = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    rows = counts.filter((F.col("toxic") >= least) & (ratio >= LEAST_RATIO)).collect()
    worth = {}
    for r in rows:
        if _chance(r.toxic, (r.toxic + r.clean) * toxic / (toxic + clean)) < MOST_CHANCE:
            worth[r.feature] = (math.log(((r.toxic + 0.5) / (toxic + 1)) / ((r.clean + 0.5) / (clean + 1))), r.toxic)
    words = {f: w for f, (w, _) in worth.items() if f[0] != "\x00"}
    stems: dict[str, float] = {}
    most: dict[str, int] = {}  # by beginning, the rows of its most frequent word
    for w in words:
        for k in STEM_LENGTHS:
            if len(w) >= k:
                most[w[:k]] = max(most.get(w[:k], 0), worth[w][1])
    for f in sorted((f for f in worth if f[0] == "\x00"), key=lambda f: (len(f), f)):
        stem = f[1:]
        # a stem must catch clearly more rows than any one word that begins with it
        if worth[f][1] > 1.2 * most.get(stem, 0) and not any(stem.startswith(s) for s in stems):
            stems[stem] = worth[f][0]
    # stems are exact; words that begin with one stay, so that their misspellings are caught
    top = max([*words.values(), *stems.values()], default=1.0)
    return {w: x / top for w, x in words.items()}, {s: x / top for s, x in stems.items()}


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to PRIOR; rows weigh alike."""
    w = PRIOR.copy()
    each = np.full(len(y), min(1.0, 2000 / len(y)))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (each * (p - y)) + 0.3 * (w - PRIOR)
        hess = (x * (each * p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """A model from the labelled rows that are not held out, about ``max_rows`` of them, each text once.

    Without labels of both kinds the model has no terms and gives every
    document the same low score. Null labels are no labels; if a doc_id has
    several, one toxic label decides.
    """
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    n = known.count()
    if n > max_rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    # bounded by max_rows, so it may be broadcast
    rows = docs.select(F.col(key).alias("_key"), whole_text(text).alias("text")).join(F.broadcast(known), F.col("_key") == F.col("doc_id"))
    rows = written(rows.groupBy("text").agg(F.max("_toxic").alias("toxic")), "training")
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return Model()
    counts = rows.mapInArrow(_counted, "feature string, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = written(counts, "counts")
    model = Model(*_lexicon(counts, sizes[1], sizes[0]))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if model.hit(w)], pa.string())], names=["word"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([model.measures(t) for t in batch.column(0).to_pylist()]).reshape(-1, len(PRIOR))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column(1)], names=[*(f"x{i}" for i in range(len(PRIOR))), "y"])

    clean_words = counts.filter(~F.startswith("feature", F.lit("\x00")) & (F.col("clean") > 0)).select("feature")
    model.harmless = frozenset(r.word for r in clean_words.mapInArrow(near, "word string").collect())
    model.__dict__.pop("memo", None)
    fitted = rows.mapInArrow(measure, ", ".join(f"x{i} double" for i in range(len(PRIOR))) + ", y int").toPandas().to_numpy(float)
    model.weights = _fit(fitted[:, :-1], fitted[:, -1])
    done(rows, counts)
    return model


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score in 0..1 and predicted of every row; null texts are empty; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), whole_text(text).alias("text"))
    scored = rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns; nothing is shuffled.

    A null text counts as empty and stays null; repeated rows, null doc_ids
    included, stay or go alike by their texts. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = [model.score(str(t or "")) < THRESHOLD for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
