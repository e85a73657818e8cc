"""Quality rules: word and line counts, and n-gram perplexity within bands of each language.

The perplexity comes from one modified Kneser-Ney model per language over the characters
themselves (``ORDER`` code points at a time). Spark counts the n-grams of all documents labelled
as good and derives continuation counts, discounts and interpolated probabilities; the model is
written as arrays sorted by n-gram, which the tasks load from the shared folder and look up by hash. An
n-gram is its context (at most ``ORDER`` - 1 code points of ``BITS`` bits in one long) and its
last character, so no two share a code; in the arrays it is the index of its context among the
n-grams that are one shorter, and the character. The arrays grow with the different n-grams of a
language's good documents: 24 to 40 bytes each. Bands are fitted from the
labelled documents' counts per language and perplexity step: the cuts that lose the least,
a good document lost weighing ``GOOD_WEIGHT`` times a bad one kept.

Cases: null and empty texts have no words (base_failed) and no perplexity; a null or unlabelled
language has no band, so that only the base rules decide; repeated rows are judged each; a null
id has no label; a text is read in stretches of ``STRETCH`` characters or more, so that a very
long one takes memory for its word numbers and distinct lines only; other columns are not read;
an empty table gives no rows, empty labels no bands.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mise.llm.common import filesystem, shared_dir, ship, stored

#: Fixed values of the contract.
SPACE = re.compile(r"[\x20\x09-\x0D]")
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20

ORDER, BITS = 4, 21
START = 0x110000            # before a text: one more than the last code point
UNIFORM = 1 / (START - 0x800)       # all code points but the surrogates
LEAST_DISCOUNT = 0.05
STEP, SLACK, GOOD_WEIGHT = 0.01, 60, 4
STRETCH, HELD = 1 << 19, 1 << 22
ODD = np.uint64(0x9E3779B97F4A7C15)
LAST = np.uint64((1 << BITS) - 1)

FEATURES = ("doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
            "n_repeat_words long, log_perplexity double")


def characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def stretches(text: str):
    """The text in pieces that end before white space, if longer than ``STRETCH``."""
    at = 0
    while len(text) - at > STRETCH:
        cut = SPACE.search(text, at + STRETCH)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def runs(text: str):
    """The characters of a whole text, a stretch at a time, each after the ``ORDER`` - 1 before it."""
    before = np.full(ORDER - 1, START, dtype=np.uint32)
    for part in stretches(text):
        symbols = np.concatenate([before, characters(part)])
        before = symbols[-(ORDER - 1):]
        yield symbols


# ---- model

def summed(context: np.ndarray, char: np.ndarray, n: np.ndarray):
    """Equal (context, char) added up."""
    contexts, of = np.unique(context, return_inverse=True)
    keys, where = np.unique(of.astype(np.uint64) << np.uint64(BITS) | char, return_inverse=True)
    total = np.zeros(len(keys), dtype=np.int64)
    np.add.at(total, where, n)
    return contexts[(keys >> np.uint64(BITS)).astype(np.int64)], (keys & LAST).astype(np.uint32), total


class Counts:
    """Counts of a language's n-grams: (context, char, n), and runs of characters not added yet."""

    def __init__(self):
        self.grams = np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64)
        self.fresh, self.size = [], 0

    def add(self, symbols: np.ndarray) -> None:
        self.fresh.append(symbols)
        self.size += len(symbols)
        if self.size > STRETCH:
            self.settle()

    def settle(self) -> None:
        if self.fresh:
            context = []
            for symbols in self.fresh:
                n = len(symbols) - ORDER + 1
                own = np.zeros(n, dtype=np.uint64)
                for k in range(ORDER - 1):
                    own = own << np.uint64(BITS) | symbols[k:k + n]
                context.append(own)
            context, char = np.concatenate(context), np.concatenate([x[ORDER - 1:] for x in self.fresh])
            self.fresh, self.size = [], 0
            new = summed(context, char, np.ones(len(char), np.int64))
            self.grams = summed(*(np.concatenate(x) for x in zip(self.grams, new)))


def count_grams(batches):
    """Batches of (lang, text) -> (lang, context, char, n): a task's counts, handed on when there
    are more than ``HELD`` of them."""
    held: dict = {}

    def out():
        for lang, counts in held.items():
            counts.settle()
            context, char, n = counts.grams
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), pa.array(context.view(np.int64)), pa.array(char.view(np.int32)), pa.array(n)],
                ["lang", "context", "char", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = held.setdefault(lang, Counts())
            for symbols in runs(text.as_py()):
                counts.add(symbols)
        if sum(len(c.grams[0]) + c.size for c in held.values()) > HELD:
            yield from out()
            held = {}
    yield from out()


def discounts(level: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: modified Kneser-Ney discounts from the counts of counts."""
    n = [F.count_if(F.col("n") == k).cast("double") for k in range(1, 5)]
    found = level.groupBy("lang").agg(*(x.alias(f"n{k + 1}") for k, x in enumerate(n)))
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)

    def d(k: int):
        raw = F.when(F.col(f"n{k}") > 0, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(y)
        return F.least(F.lit(float(k)), F.greatest(F.lit(LEAST_DISCOUNT), raw)).alias(f"d{k}")
    return found.select("lang", d(1), d(2), d(3))


def model(good: DataFrame) -> DataFrame:
    """(lang, level, context, char, log_p, log_rest) of documents (lang, text).

    ``log_p``: log10 of the interpolated probability of ``char`` after ``context``, an n-gram of
    ``level`` characters; ``log_rest``: log10 of what the n-gram leaves, as a context, to shorter
    ones (null where it is no context). Level 0 is the empty context."""
    ship(good.sparkSession)
    counted = good.select("lang", "text").mapInArrow(count_grams, "lang string, context long, char int, n long")
    level = stored(counted.groupBy("lang", "context", "char").agg(F.sum("n").alias("n")), "grams")
    levels = {ORDER: level}
    for k in range(ORDER - 1, 0, -1):       # continuation counts: distinct characters before
        level = levels[k + 1].groupBy("lang", shorter(k + 1), "char").agg(F.count("*").alias("n"))
        levels[k] = stored(level.withColumnRenamed("shorter", "context"), f"grams-{k}")
    probability, out = None, []
    for k in range(1, ORDER + 1):
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        each = levels[k].join(discounts(levels[k]), "lang").withColumn("cut", cut)
        contexts = each.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("rest"))
        each = each.join(contexts, ["lang", "context"])
        if probability is None:
            each = each.withColumn("lower", F.lit(UNIFORM))
        else:
            each = each.select("*", shorter(k)).join(probability.select(
                "lang", F.col("context").alias("shorter"), "char", F.col("p").alias("lower")), ["lang", "shorter", "char"])
        probability = stored(each.select("lang", "context", "char", ((F.col("n") - F.col("cut")) / F.col("total")
                                                                     + F.col("rest") * F.col("lower")).alias("p")), f"model-{k}")
        out.append(probability.select("lang", F.lit(k).alias("level"), "context", "char", F.log10("p").alias("log_p"),
                                      F.lit(None).cast("double").alias("log_rest")))
        out.append(contexts.select("lang", F.lit(k - 1).alias("level"), F.shiftright("context", BITS).alias("context"),
                                   F.col("context").bitwiseAND(int(LAST)).cast("int").alias("char"),
                                   F.lit(None).cast("double").alias("log_p"), F.log10("rest").alias("log_rest")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("lang", "level", "context", "char").agg(F.max("log_p").alias("log_p"), F.max("log_rest").alias("log_rest"))


def shorter(level: int) -> F.Column:
    """The context of an n-gram of ``level`` characters without its first character."""
    return F.col("context").bitwiseAND((1 << BITS * max(level - 2, 0)) - 1).alias("shorter")


def write_model(rows: DataFrame) -> str:
    """The model as sorted arrays in the shared folder."""
    path = shared_dir(rows.sparkSession, "perplexity-model")
    order = ["lang", "level", "context", "char"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    return path


class Places:
    """Where each of different 64-bit keys stands, by open addressing: at most half of the slots are
    taken, so that a key is found after one or two looks at any number of keys."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))       # the last is read for -1 and not used
        bits = max(2 * len(keys), 2).bit_length()
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self.first(keys)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            waits = self.slots[slot] != left
            left, slot = left[waits], (slot[waits] + 1) & self.last

    def first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * ODD) >> self.shift).astype(np.int64)

    def find(self, asked: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it is not there."""
        slot = self.first(asked)
        at = self.slots[slot]
        left = np.flatnonzero((self.keys[at] != asked) & (at >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.last
            own = self.slots[slot[left]]
            at[left] = own
            left = left[(self.keys[own] != asked[left]) & (own >= 0)]
        return at


class Arrays:
    """A language's n-grams: for each level sorted keys (index of the context in the level below
    and last character), log10 probabilities and rests, not a number where there is none."""

    def __init__(self, levels: dict):
        self.places = {k: Places(levels[k][0]) for k in range(2, ORDER + 1)}
        # an n-gram that is not there, -1, has no probability and leaves all to shorter ones
        self.log_p = {k: np.append(levels[k][1], np.nan) for k in levels}
        self.rest = {k: np.append(np.nan_to_num(levels[k][2]), 0.0) for k in range(ORDER)}
        # the level of single characters by code point
        self.single = np.full(START + 1, -1, np.int32)
        keys = levels[1][0].astype(np.int64)
        self.single[keys] = np.arange(len(keys))

    def logs(self, symbols: np.ndarray) -> np.ndarray:
        """log10 probabilities of the characters of a run from the ``ORDER``-th on."""
        n = len(symbols) - ORDER + 1
        found = self.single[symbols]            # the n-gram of k characters that ends at each place, or -1
        total = np.full(n, np.log10(UNIFORM))
        total += self.rest[0][0]
        for k in range(1, ORDER + 1):
            if k > 1:
                # the context of each place; that of none, -1, is in no key
                asked = found[:-1].astype(np.uint64) << np.uint64(BITS) | symbols[k - 1:]
                found = self.places[k].find(asked)
            p = self.log_p[k][found[ORDER - k:]]
            total = np.where(np.isnan(p), total, p)
            if k < ORDER:                       # what this context leaves, where the next level knows no more
                total += self.rest[k][found[ORDER - 1 - k:-1]]
        return total


@lru_cache(maxsize=1)
def load_model(path: str) -> dict:
    """lang -> Arrays, read once per worker."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector
    fs, root = filesystem(path)
    files = sorted(i.path for i in fs.get_file_info(FileSelector(root)) if i.base_name.startswith("part-"))
    whole = pa.concat_tables([pq.read_table(f, filesystem=fs) for f in files])
    langs = whole["lang"].combine_chunks().dictionary_encode()
    of, level = langs.indices.to_numpy(), whole["level"].to_numpy()
    context, char = whole["context"].to_numpy().astype(np.uint64), whole["char"].to_numpy().astype(np.uint64)
    log_p, rest = (whole[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in ("log_p", "log_rest"))
    out = {}
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        levels, packed = {}, None
        for k in range(ORDER + 1):
            take = np.flatnonzero((of == i) & (level == k))
            take = take[np.lexsort((char[take], context[take]))]
            # every context is an n-gram of the level below, so its place there stands for it
            within = np.searchsorted(packed, context[take]) if k > 1 else np.zeros(len(take), np.int64)
            levels[k] = within.astype(np.uint64) << np.uint64(BITS) | char[take], log_p[take], rest[take] if k < ORDER else None
            packed = context[take] << np.uint64(BITS) | char[take]
        out[lang] = Arrays(levels)
    return out


# ---- documents

def repeated_words(ids: np.ndarray) -> int:
    """Words within windows that occur twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    code = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        code = (code ^ ids[k:k + n]) * ODD
        code ^= code >> np.uint64(31)
    ordered = np.sort(code)
    if (ordered[1:] != ordered[:-1]).all():
        return 0
    _, where, count = np.unique(code, return_inverse=True, return_counts=True)
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    again = count[where] > 1
    edges[:n] += again
    edges[WINDOW:WINDOW + n] -= again
    return int((np.cumsum(edges) > 0).sum())


def base(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    known = defaultdict(count().__next__)
    ids, chars = [], 0
    for part in stretches(text):
        words = part.encode().split()           # of bytes, it cuts at ``BLANKS`` and nowhere else
        chars += len(part) - sum(map(part.count, BLANKS))
        ids.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    ids = np.concatenate(ids)
    lines, repeats = set(), 0
    for line in text.split("\n"):
        if line in lines:
            repeats += 1
        elif line.strip(BLANKS):
            lines.add(line)
    return len(ids), chars, sum(map(text.count, SYMBOLS)), repeats, repeated_words(ids)


def measure(batches, path: str | None):
    """Batches of (doc_id, lang, text) -> FEATURES."""
    models = load_model(path) if path else {}
    names = [c.split()[0] for c in FEATURES.split(", ")]
    for batch in batches:
        rows = []
        for text, lang in zip(batch.column(2), batch.column(1).to_pylist()):
            text = text.as_py()
            found, log = models.get(lang), None
            if found is not None and text:
                log = -sum(float(found.logs(symbols).sum()) for symbols in runs(text)) / len(text)
            rows.append((*base(text), log))
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.float64())],
            names)


def bands(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """lang, low, high: the log10 perplexities between which a language's documents are kept.

    Counts per step of ``STEP`` of good and bad documents that pass the base rules; each cut
    is the middle of the steps at which the weighted loss is least."""
    graded = labels.filter("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("quality"))
    counts = measured.filter("NOT base_failed AND log_perplexity IS NOT NULL AND lang IS NOT NULL").join(graded, "doc_id").groupBy(
        "lang", F.floor(F.col("log_perplexity") / STEP).alias("step")).agg(
        F.sum(F.when(F.col("quality") > 0, GOOD_WEIGHT).otherwise(0)).alias("good"),
        F.count_if(F.col("quality") <= 0).alias("bad"))
    # every step of a language from SLACK below its documents to SLACK above them
    ends = counts.groupBy("lang").agg((F.min("step") - SLACK).alias("a"), (F.max("step") + SLACK).alias("b"))
    steps = ends.select("lang", F.explode(F.sequence("a", "b")).alias("step")).join(counts, ["lang", "step"], "left").fillna(
        0, ["good", "bad"])
    below = Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy("lang").orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    either = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    loss = steps.select("lang", "step", (either("good", onward) + either("bad", below)).alias("high"),
                        (either("good", below) + either("bad", onward)).alias("low"))
    least = Window.partitionBy("lang")
    best = loss.withColumn("least_high", F.min("high").over(least)).withColumn("least_low", F.min("low").over(least))
    middle = lambda c: F.floor((F.min(c) + F.max(c) + 1) / 2) * STEP
    return best.groupBy("lang").agg(
        middle(F.when(F.col("low") == F.col("least_low"), F.col("step"))).alias("low"),
        middle(F.when(F.col("high") == F.col("least_high"), F.col("step"))).alias("high"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, perplexity, band and verdict of each document."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    good = labels.filter("quality > 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    # the same plan at every size: the labels' number has no bound, so they are never broadcast
    learnt = rows.filter("lang IS NOT NULL").join(good.hint("shuffle_merge"), "doc_id", "left_semi")
    path = write_model(model(learnt))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    measured = stored(rows.mapInArrow(lambda b: measure(b, path), FEATURES).withColumn("base_failed", failed), "measured")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return measured.join(bands(measured, labels), "lang", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & inside).alias("kept"), F.pow(F.lit(10.0), F.col("log_perplexity")).alias("perplexity"),
        F.pow(F.lit(10.0), F.col("low")).alias("least_perplexity"), F.pow(F.lit(10.0), F.col("high")).alias("most_perplexity"))
