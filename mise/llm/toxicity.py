"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Folding: lower case, compatibility forms, look-alike letters of other scripts and digits in
place of letters to plain letters, punctuation to spaces. Lexicon: words and word beginnings
of 4 to 8 letters whose folded forms are clearly likelier in texts labelled toxic; the weight
of a term is the lower confidence bound of its log odds. Exception phrases: pairs of words
around a term that are clearly likelier in texts labelled clean; a term inside one does not
count. A text's matches are summed (of several terms on one word the heaviest), once as they
are and once divided by the text's length, and a logistic curve turns both into a score.

Fitting uses labelled documents only, a sample of at most ``FIT_ROWS`` labels. Each half of
it is measured with a lexicon learned from the other half, and the curve is fitted to that,
so that terms that only happened to be frequent count for little; the final lexicon comes
from both halves. Term counts are partially aggregated on the
executors; what reaches the driver is at most ``TERMS`` terms and ``EXCEPTIONS`` phrases
of each half and of both, and three numbers per fitted document. Labels, ids, language and source are no inputs of a score.

Cases: a null or empty text has no matches and gets the curve's value for none; labels that
are null or conflict for a document (the larger wins) never fail; without labels of both
kinds every score is 0; repeated rows get equal scores; extra columns are kept by ``reject``
and ignored by ``score``; an empty table gives no rows.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mise.llm.common import id_text, ship, stored

FIT_ROWS = 20_000
TERMS = 4_000
EXCEPTIONS = 1_000
MIN_SUPPORT = 3
MIN_WEIGHT = 0.3
CAUTION = 2.5           # standard errors taken off a term's log odds
PREFIXES = range(4, 9)
SPREAD = 20             # words added to a text's length before dividing by it
THRESHOLD = 0.3
COUNTS = ("pos0", "neg0", "pos1", "neg1")

# fixed values: letters of other scripts and digits that look like Latin letters
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a",
}
TABLE = str.maketrans({**{c: " " for c in "!\"#$%&'()*+,-./:;<=>?[\\]^_`{|}~«»“”‘’„…–—¿¡"}, **LOOKALIKES})


def fold(text: str) -> str:
    """Folded words, one space around each."""
    text = text.lower()
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return f" {' '.join(text.translate(TABLE).split())} "


def terms(word: str) -> list[str]:
    """The lexicon entries that a folded word could match: itself closed, its beginnings open."""
    return [f" {word} ", *(f" {word[:k]}" for k in PREFIXES if k < len(word))]


@dataclass
class Model:
    lexicon: dict[str, float]
    exceptions: list[str]
    curve: tuple[float, ...] | None     # intercept and slopes; None: nothing to learn from

    def automaton(self):
        import ahocorasick
        a = ahocorasick.Automaton()
        for t, w in self.lexicon.items():
            a.add_word(t, (len(t), w))
        for t in self.exceptions:
            a.add_word(t, (len(t), None))
        a.make_automaton()
        return a


def matches(folded: str, automaton) -> tuple[float, float]:
    """(sum of weights, the same per word) of a folded text."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for last, (size, weight) in automaton.iter(folded):
        at = last - size + 1
        if weight is None:
            spared.append((at, last))
        elif weight > best.get(at, 0.0):
            best[at] = weight
    if spared:
        best = {at: w for at, w in best.items() if not any(a <= at < b for a, b in spared)}
    total = sum(best.values())
    return total, total / (folded.count(" ") - 1 + SPREAD)


def features(total: float, rate: float) -> tuple[float, float]:
    return math.log1p(total), 100 * rate


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), np.diag([0.0, *[ridge] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - keep @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def is_training(doc_id: F.Column) -> F.Column:
    """Documents whose labels may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn lexicon, exceptions and curve from the training documents' labels."""
    spark = docs.sparkSession
    ship(spark)
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")
                           ).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(is_training(F.col("doc_id"))
                           ).groupBy("doc_id").agg(F.max("toxic").alias("toxic")
                           ).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    # at most FIT_ROWS rows of 12 bytes; equal texts are one example
    sample = id_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("text").agg(
        F.max("toxic").alias("toxic")).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)))
    sample = stored(sample, "labelled-texts")
    size = {(r["half"], r["toxic"]): r["n"] for r in
            sample.groupBy("half", (F.col("toxic") == 1).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = ([size.get((h, t), 0) for h in (0, 1)] for t in (1, 0))
    if not all(n_pos) or not all(n_neg):
        return Model({}, [], None)

    def counted(of) -> DataFrame:
        """Documents of each half and label that hold a term: (term, pos0, neg0, pos1, neg1)."""
        def count(batches):
            seen = [Counter() for _ in COUNTS]
            for b in batches:
                for text, toxic, half in zip(*(c.to_pylist() for c in b.columns)):
                    seen[2 * half + (toxic != 1)].update(of(fold(text)))
            keys = list(set().union(*seen))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in seen)],
                names=["term", *COUNTS])
        return sample.select("text", "toxic", "half").mapInArrow(
            count, "term string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("term").agg(
            *(F.sum(c).alias(c) for c in COUNTS))

    def best(counts: DataFrame, halves: tuple, sign: int, most: int) -> dict[str, float]:
        """The terms whose log odds in these halves are surely positive (sign 1) or negative."""
        pos, neg = (sum(F.col(f"{kind}{h}") for h in halves) for kind in ("pos", "neg"))
        n1, n0 = sum(n_pos[h] for h in halves), sum(n_neg[h] for h in halves)
        odds = F.log((pos + 0.5) / (n1 + 1)) - F.log((neg + 0.5) / (n0 + 1))
        weight = odds * sign - CAUTION * F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
        rows = counts.filter((pos if sign > 0 else neg) >= MIN_SUPPORT).select("term", weight.alias("weight")).filter(
            F.col("weight") > MIN_WEIGHT).orderBy(F.desc("weight"), "term").limit(most)
        return {r["term"]: r["weight"] for r in rows.collect()}

    words = stored(counted(lambda t: {x for w in set(t.split()) for x in terms(w)}), "term-counts")
    folds = ((0,), (1,), (0, 1))
    lexicons = [best(words, h, 1, TERMS) for h in folds]
    known = set().union(*lexicons)

    def around(folded: str) -> set[str]:
        own = folded.split()
        hit = [any(t in known for t in terms(w)) for w in own]
        return {f" {a} {b} " for a, b, p, q in zip(own, own[1:], hit, hit[1:]) if p or q}

    pairs = stored(counted(around), "phrase-counts")
    models = [Model(lex, list(best(pairs, h, -1, EXCEPTIONS)), None) for lex, h in zip(lexicons, folds)]

    def measure(batches):
        automata = [m.automaton() if m.lexicon else None for m in models[:2]]
        for b in batches:
            got = []
            for text, half in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                a = automata[1 - half]      # terms learned from the other half
                got.append(features(*matches(fold(text), a)) if a else (0.0, 0.0))
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()),
                 b.column(1)], names=["total", "rate", "toxic"])

    rows = sample.select("text", "toxic", "half").mapInArrow(
        measure, "total double, rate double, toxic int").collect()      # at most FIT_ROWS
    x = np.array([[r["total"], r["rate"]] for r in rows])
    models[2].curve = fit_curve(x, np.array([float(r["toxic"] == 1) for r in rows]))
    return models[2]


def scorer(model: Model):
    """Function of a list of texts: their scores."""
    if model.curve is None:
        return lambda texts: [0.0] * len(texts)
    automaton = model.automaton() if model.lexicon else None
    b, *w = model.curve

    def one(text):
        x = features(*matches(fold(text or ""), automaton)) if automaton else (0.0, 0.0)
        z = b + sum(p * q for p, q in zip(w, x))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    return lambda texts: [one(t) for t in texts]


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)      # at most TERMS + EXCEPTIONS entries

    def run(batches):
        of = scorer(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of(b.column(1).to_pylist()), pa.float64())],
                                             names=["doc_id", "score"])

    scored = id_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(~is_training(F.col("doc_id")), F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold, with all their columns."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        of = scorer(sent.value)
        for b in batches:
            yield b.filter(pa.array([s < threshold for s in of(b.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
