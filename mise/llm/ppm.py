r"""Language-model scores by prediction by partial matching over byte contexts.

A text is the sequence of its words (runs of other bytes than ``[\x20\x09-\x0D]``, A-Z
lower-cased) and one end. Each word is coded byte by byte and closed by a space, the end is a
newline at the place of a word. The model is a trie of the contexts of 0 to ``ORDER`` bytes
that precede a byte: with ``across``, of the text (the words joined by spaces, one in front),
over the space into the words before; else never reaching back beyond the space before its
word. Escape estimation
is method C: a context seen T times with D different successors gives the escape D / (T + D).
After an escape the shorter context is used without the successors of the longer one (symbol
exclusion); after all contexts the remaining byte values are equally likely.

Two longer contexts stand above the trie, each with one escape: a whole word is coded as in
training with probability 1 - e, else (e) by the trie, and a whole phrase (the words up to one
that ends in ``.``, ``!`` or ``?``, or up to the end) as in training, else by its words. The
escapes are the share of words or phrases seen once (Good and Turing); with ``across`` that of
words is 1/2, as the trie then knows what the count of a word does not: the words before it. A way to code a text is
chosen at random, so probabilities add up and stay at most 1 over all texts. A training
document's own occurrence of a phrase does not count for it.

Everything is scored once, with pretrained counts; nothing is broadcast and nothing but a few
numbers reaches the driver. Inside words:

1. Documents go to blocks; a block's words and phrases (by hash) are counted once per
   block (compressed texts and (block, key, counts) are exchanged), then added up per key, with
   the list of its blocks. A phrase that occurs once in all texts can match nothing and goes.
2. Words with training counts give successor counts of all contexts, partially added up.
3. Words go to word blocks; each asks for the contexts that occur in its words, gets that part
   of the trie by a join, and scores its words.
4. Scores return to the blocks that hold the words and are summed per document.

Over the space (``across``):

1. Texts are packed into stored blocks of about ``BLOCK_BYTES``. A block's different words and
   phrases and the bytes after its contexts of less than ``SPLIT`` bytes go, compressed, with their
   training counts to parts by hash; a part adds up and sends each block the counts in its order.
2. A window is a byte with the (at most ``order``) bytes before it, one 64-bit number. A block's
   different windows go, sorted and compressed, with their training counts to parts by the last
   ``SPLIT`` bytes of their context, so that a part holds every longer context whole.
3. A part adds up the windows of all blocks, builds its part of the trie, with the short contexts
   from the stored counts, and sends each block the scores of its windows in their order.
4. A block looks up its windows' scores and sums them per word and document.

Every group is bounded: a block by its bytes or its longest text, a part by the compressed windows
or words that it gets, as the number of parts grows with that of blocks. A frequent word or window
costs one number per block, inside words one row.

Cases: a null or empty text is the end alone; null ids count as training documents; repeated
rows are separate documents; with no training documents all byte values are equally likely
and the base score of a token is 0; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mise.llm.common import filesystem, id_text, partitions, shared_dir, ship, stored

ORDER = 6
WORDS = 1 << 19
ADD = 0.1
CHUNK = 20_000
LN = np.log(10.0)
SPACE, END = b" ", b"\n"
PHRASES = b"  "             # the key that counts all phrases; a space begins a phrase's key
PRECEDED = b"\t"            # begins the key of a unit with the bytes before its word; or of a short context
BLOCK_BYTES = 8 << 20
BLOCKS_PER_PART = 4
SLICE_BYTES = 1 << 20
SPLIT = 3
HASH = np.uint64(0x9E3779B97F4A7C15)
PHRASE_END = re.compile(rb"(?<=[.!?]) ")
PHRASE_LAST = np.isin(np.arange(256), list(b".!?" + END))     # last bytes of words that end phrases


def phrases(words: list[bytes]) -> list[bytes]:
    """The words of a text as phrases; the end is part of the last."""
    parts = PHRASE_END.split(SPACE.join(words)) if words else []
    if parts and parts[-1][-1:] not in b".!?":
        parts[-1] += END
    else:
        parts.append(END)
    return parts


def phrase_keys(parts: list[bytes]) -> list[bytes]:
    return [SPACE + xxhash.xxh3_128_digest(x) for x in parts]


def phrase_sizes(parts: list[bytes]) -> np.ndarray:
    """Words in each phrase, the end counted."""
    size = np.array([x.count(SPACE) + 1 for x in parts])
    if parts[-1] != END:
        size[-1] += parts[-1].endswith(END)
    return size


def units(words: list[bytes], order: int) -> list[bytes]:
    """Keys of a text's words and its end, each with the (at most ``order``) bytes before it."""
    out, before = [], SPACE
    for w in [*words, END]:
        out.append(PRECEDED + before + w)
        before = (before + w + SPACE)[-order:] if order else b""
    return out


def is_held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def blocked(docs: DataFrame, blocks: int) -> DataFrame:
    """(doc_id, held_out, block, z: the lower-cased text, compressed)."""
    rows = id_text(docs)
    rows = rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.pmod(
        F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "text")

    def squeeze(batches):
        import zstandard
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = [packer.compress(t.encode().lower()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(z, pa.binary())],
                                             names=["doc_id", "held_out", "block", "z"])

    return rows.mapInArrow(squeeze, "doc_id long, held_out boolean, block int, z binary")


def block_words(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, word, n, m): the words and phrases of each block, with their number in its
    training documents and in all."""
    def tally(batches):
        import zstandard
        unpacker = zstandard.ZstdDecompressor()
        block, trained, other = None, Counter(), Counter()
        for b in batches:
            for own, held, z in zip(*(b.column(c).to_pylist() for c in ("block", "held_out", "z"))):
                if own != block:
                    if block is not None:
                        yield counted(block, trained, other)
                    block, trained, other = own, Counter(), Counter()
                words = unpacker.decompress(z).split()
                keys = phrase_keys(phrases(words))
                into = other if held else trained
                into.update(words)
                into.update(keys)
                into[END] += 1
                into[PHRASES] += len(keys)
        if block is not None:
            yield counted(block, trained, other)

    own = docs.select("block", "held_out", "z").repartition(blocks, "block").sortWithinPartitions("block")
    return own.mapInArrow(tally, "block int, word binary, n long, m long")


def counted(block: int, trained: Counter, other: Counter) -> pa.RecordBatch:
    words = [*trained, *(w for w in other if w not in trained)]
    n = np.zeros(len(words), np.int64)
    n[:len(trained)] = list(trained.values())
    m = n + np.fromiter((other.get(w, 0) for w in words), np.int64, len(words))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(words), block, np.int32)), pa.array(words, pa.binary()), pa.array(n), pa.array(m)],
        names=["block", "word", "n", "m"])


class Positions:
    """The coded bytes of a list of words or units: contexts of each order and the byte itself."""

    def __init__(self, words: list[bytes], order: int):
        shown = [w[1:] if w.startswith(PRECEDED) else SPACE + w for w in words]
        # the space before a word, and what a unit has before that, is given
        given = np.array([u.rfind(SPACE) + 1 for u in shown], np.int64)
        shown = [u if u.endswith(END) else u + SPACE for u in shown]
        raw = np.frombuffer(b"".join(shown), np.uint8)
        size = np.array([len(u) for u in shown])
        start = np.cumsum(size) - size
        place = np.arange(len(raw)) - np.repeat(start, size)
        at = np.flatnonzero(place >= np.repeat(given, size))
        self.symbol = raw[at]
        self.depth = np.minimum(place[at], order)       # longest context
        self.word = np.repeat(np.arange(len(shown)), size - given)
        self.context = [np.zeros(len(at), np.uint64)]
        packed = np.zeros(len(at), np.uint64)
        for k in range(1, order + 1):
            has = self.depth >= k
            packed = packed + (np.where(has, raw[np.where(has, at - k, 0)], 0).astype(np.uint64) << np.uint64(8 * (k - 1)))
            self.context.append(packed + tag(k))


def tag(k: int) -> np.uint64:
    """Contexts of different orders are different numbers: the order is their top byte."""
    return np.uint64(k << 56)


def parent(context: np.ndarray) -> np.ndarray:
    """The context without its oldest byte; that of order 0 is itself."""
    k = (context >> np.uint64(56)).astype(np.int64)
    less = np.maximum(k - 1, 0)
    low = context & ((np.uint64(1) << (8 * less).astype(np.uint64)) - np.uint64(1))
    return low | (less.astype(np.uint64) << np.uint64(56))


def summed(context: np.ndarray, symbol: np.ndarray, n: np.ndarray):
    """Equal (context, symbol) added up."""
    order = np.lexsort((symbol, context))
    context, symbol, n = context[order], symbol[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (symbol[1:] != symbol[:-1])]))
    return context[first], symbol[first], np.add.reduceat(n, first)


def successor_counts(words: DataFrame, order: int) -> DataFrame:
    """(context, symbol, n) over the training words, added up per task."""
    def count(batches):
        kept = None
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                p = Positions(part.column("word").to_pylist(), order)
                n = part.column("n").to_numpy()[p.word]
                own = []
                for k in range(order + 1):
                    has = p.depth >= k
                    if has.any():
                        own.append(summed(p.context[k][has], p.symbol[has], n[has]))
                if not own:
                    continue
                own = [np.concatenate(x) for x in zip(*own)]
                kept = own if kept is None else [np.concatenate(x) for x in zip(kept, own)]
                if len(kept[0]) > 1 << 21:
                    kept = list(summed(*kept))
                    if len(kept[0]) > 1 << 20:
                        yield rows(kept)
                        kept = None
        if kept is not None:
            yield rows(summed(*kept))

    def rows(x):
        return pa.RecordBatch.from_arrays(
            [pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int16)), pa.array(x[2])],
            names=["context", "symbol", "n"])

    return words.filter("n > 0").select("word", "n").mapInArrow(
        count, "context long, symbol short, n long").groupBy("context", "symbol").agg(F.sum("n").alias("n"))


def asked(words: DataFrame, order: int) -> DataFrame:
    """(wblock, context): the contexts in the words of each word block."""
    def ask(batches):
        block, kept = None, []

        def rows():
            own = np.unique(np.concatenate(kept))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block, np.int32)),
                                               pa.array(own.view(np.int64))], names=["wblock", "context"])

        for b in batches:
            ids = b.column("wblock").to_numpy()
            for own in np.unique(ids):
                part = b.filter(pa.array(ids == own))
                if own != block:
                    if kept:
                        yield rows()
                    block, kept = own, []
                for at in range(0, part.num_rows, CHUNK):
                    p = Positions(part.column("word").slice(at, CHUNK).to_pylist(), order)
                    kept.append(np.unique(np.concatenate([c[p.depth >= k] for k, c in enumerate(p.context)])))
                if len(kept) > 20:
                    kept = [np.unique(np.concatenate(kept))]
        if kept:
            yield rows()

    return words.mapInArrow(ask, "wblock int, context long")


class Trie:
    """Contexts with their successors, as sorted arrays."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray, n: np.ndarray):
        order = np.lexsort((symbol, context))
        context, symbol, n = context[order], symbol[order], n[order].astype(np.float64)
        self.contexts, first, sizes = np.unique(context, return_index=True, return_counts=True)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.keys = owner * 256 + symbol.astype(np.int64)
        self.n = n
        self.distinct = sizes.astype(np.float64)
        if len(n):
            self.total = np.add.reduceat(n, first)
            # what the next shorter context counts for the successors of this one
            up = self.find(parent(self.contexts))
            below = self.count(up[owner], symbol)
            self.excluded = np.add.reduceat(below, first)
        else:
            self.total = self.excluded = np.zeros(0)

    def find(self, context: np.ndarray) -> np.ndarray:
        """Index of each context, -1 where it is not known."""
        if not len(self.contexts):
            return np.full(len(context), -1)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        return np.where(self.contexts[at] == context, at, -1)

    def count(self, index: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(index))
        key = index * 256 + symbol.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (index >= 0), self.n[at], 0.0)

    def log10(self, p: Positions) -> np.ndarray:
        """log10 probability of every coded byte."""
        last = len(p.context) - 1
        index = [np.where(p.depth >= k, self.find(p.context[k]), -1) for k in range(last + 1)]
        counts = [self.count(i, p.symbol) for i in index]
        zero = index[0] >= 0
        known = self.distinct[index[0]] if len(self.distinct) else np.zeros(len(zero))
        after = 1.0 / (256 - np.where(zero, np.minimum(known, 255), 0))     # after an escape from order 0
        best = after.copy() if not len(self.distinct) else self.direct(index[0], counts[0], after)
        for k in range(1, last + 1):
            here = np.flatnonzero(index[k] >= 0)
            i, up, c = index[k][here], index[k - 1][here], counts[k - 1][here]
            total = self.total[up] - self.excluded[i]
            distinct = self.distinct[up] - self.distinct[i]
            room = total + distinct
            with np.errstate(divide="ignore", invalid="ignore"):
                after[here] = np.where(room <= 0, after[here], np.where(
                    c > 0, c / room, distinct / room * after[here]))
            best[here] = self.direct(i, counts[k][here], after[here])
        return np.log10(best)

    def direct(self, index: np.ndarray, n: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Probability from a context without exclusions, ``after`` being that after its escape."""
        total, distinct = self.total[index], self.distinct[index]
        p = np.where(n > 0, n, distinct * after) / (total + distinct)
        return np.where(index >= 0, p, after)


def word_scores(words: list[bytes], trie: Trie, order: int) -> np.ndarray:
    out = []
    for at in range(0, len(words), CHUNK):
        part = words[at:at + CHUNK]
        p = Positions(part, order)
        out.append(np.bincount(p.word, trie.log10(p), minlength=len(part)))
    return np.concatenate(out) if out else np.zeros(0)


def is_phrase() -> F.Column:
    return F.startswith(F.col("word"), F.lit(SPACE))


class Numbers:
    """What the scores above the trie need from the counts of all words and phrases: different words,
    their training counts, those with a count and with the count 1; counts of phrases, those with 1."""

    def __init__(self, totals, across: bool):
        self.words, self.n_tokens, known, once, self.n_phrases, phrases_once = (int(x or 0) for x in totals)
        self.scale = self.n_tokens + ADD * (known + 1)
        self.word_escape = 0.5 if across else (once + 1) / (self.n_tokens + 2)
        self.phrase_escape = (phrases_once + 1) / (self.n_phrases + 2)

    def scores(self, n: np.ndarray):
        """(base score, log10 probability of being coded as in training) of words by their counts."""
        with np.errstate(divide="ignore"):
            return np.log10((n + ADD) / self.scale), np.log10((1 - self.word_escape) * n / max(self.n_tokens, 1))

    def by_phrase(self, first, seen, wordwise, bytewise):
        """Natural log scores of phrases that begin at the words ``first``, by how often they are seen
        elsewhere in training and the log10 scores of the words."""
        rated = np.logaddexp(wordwise * LN, (np.log10(self.word_escape) + bytewise) * LN) / LN
        by_words = np.add.reduceat(rated, first)
        with np.errstate(divide="ignore"):
            whole = np.log10((1 - self.phrase_escape) * np.maximum(seen, 0) / max(self.n_phrases, 1))
        return np.logaddexp(whole * LN, (np.log10(self.phrase_escape) + by_words) * LN)

    def document(self, parts, seen, n, at, base, wordwise, bytewise):
        """n_tokens, n_known, base_score, score of a text whose words stand at ``at``, by its phrases
        and how often they are seen elsewhere in training."""
        first = np.cumsum(size := phrase_sizes(parts)) - size
        score = self.by_phrase(first, seen, wordwise[at], bytewise).sum() / LN
        return len(at), int((n[at] > 0).sum()), float(base[at].sum()), float(score)


def keys_of(rows: DataFrame) -> DataFrame:
    """(word, n, blocks) of (block, word, n, m): added up, without phrases that occur once."""
    return stored(rows.groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("m").alias("m"), F.collect_list("block").alias("blocks")).filter(
        ~is_phrase() | (F.col("m") > 1)).select("word", "n", "blocks"), "words")


def totals(keys: DataFrame) -> list:
    """The totals of ``Numbers`` from ``keys_of``; phrases that occur once are told by the key of all."""
    n, whole = F.col("n"), F.col("word") == F.lit(PHRASES)
    word, again = ~is_phrase(), is_phrase() & ~whole
    r = keys.agg(F.count_if(word).alias("words"), F.sum(F.when(word, n)).alias("n"), F.count_if(word & (n > 0)).alias("known"),
                 F.count_if(word & (n == 1)).alias("once"), F.sum(F.when(whole, n)).alias("phrases"),
                 F.sum(F.when(again, n)).alias("again"), F.count_if(again & (n == 1)).alias("again_once")).first()
    return [*r[:5], (r["phrases"] or 0) - (r["again"] or 0) + r["again_once"]]


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scored(ids, held, rows) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 4
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.table([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                    names=[c.split()[0] for c in SCORED.split(", ")])


def with_total(rows: DataFrame, numbers: Numbers) -> DataFrame:
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(numbers.n_tokens).cast("long").alias("train_tokens"),
                       "base_score", "score")


def score(docs: DataFrame, order: int = ORDER, words_per_block: int = WORDS, across: bool = False) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per document."""
    spark = docs.sparkSession
    ship(spark)
    if across:
        return running(docs, order)
    blocks = partitions(spark)
    texts = blocked(docs, blocks)
    keys = keys_of(block_words(texts, blocks))
    numbers = Numbers(totals(keys), False)
    words = keys.filter(~is_phrase())
    looked_up = keys.filter(is_phrase() & (F.col("word") != F.lit(PHRASES)))

    trie = stored(successor_counts(words, order).groupBy("context").agg(
        F.collect_list(F.struct("symbol", "n")).alias("next")), "trie")
    w = max(1, -(-numbers.words // words_per_block))
    dealt = words.withColumn("wblock", F.pmod(F.xxhash64("word"), F.lit(w)).cast("int"))
    wanted = asked(dealt.select("wblock", "word").repartition(w, "wblock").sortWithinPartitions("wblock"), order)
    fetched = wanted.join(trie, "context").select("wblock", "context", "next")

    def rate(key, own, part):
        nexts = part.column("next").combine_chunks()
        flat = nexts.flatten()
        sizes = np.diff(nexts.offsets.to_numpy())
        context = np.repeat(part.column("context").to_numpy().view(np.uint64), sizes)
        model = Trie(context, flat.field("symbol").to_numpy().astype(np.int64), flat.field("n").to_numpy())
        rated = word_scores(own.column("word").to_pylist(), model, order)
        return own.select(["word", "n", "blocks"]).append_column("score", pa.array(rated))

    rated = dealt.groupBy("wblock").cogroup(fetched.groupBy("wblock")).applyInArrow(
        rate, "word binary, n long, blocks array<int>, score double")
    returned = rated.unionByName(looked_up.withColumn("score", F.lit(0.0))).select(
        F.explode("blocks").alias("block"), "word", "n", "score")

    def total_up(key, own, known):
        import zstandard
        unpacker = zstandard.ZstdDecompressor()
        place = {w: k for k, w in enumerate(known.column("word").to_pylist())}
        n, bytewise = known.column("n").to_numpy(), known.column("score").to_numpy()
        base, wordwise = numbers.scores(n)
        ids, held, out = (own.column(c).to_pylist() for c in ("doc_id", "held_out", "z"))
        rows = []
        for z, h in zip(out, held):
            words = unpacker.decompress(z).split()
            at = np.fromiter(map(place.__getitem__, [*words, END]), np.int64, len(words) + 1)
            parts = phrases(words)
            seen = np.array([n[place[k]] - (not h) if k in place else 0 for k in phrase_keys(parts)])
            rows.append(numbers.document(parts, seen, n, at, base, wordwise, bytewise[at]))
        return scored(ids, held, rows)

    return with_total(texts.groupBy("block").cogroup(returned.groupBy("block")).applyInArrow(total_up, SCORED), numbers)


# ---- contexts over the space

def packed(docs: DataFrame) -> DataFrame:
    """(block, ids, held, sizes, z): texts as ``Texts`` shows them, lower-cased, in stored blocks of about
    ``BLOCK_BYTES``."""
    rows = id_text(docs)
    rows = rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")

    def pack(batches):
        import zstandard
        from pyspark import TaskContext
        packer, block = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        ids, held, texts, size = [], [], [], 0

        def row():
            values = ([block], pa.int64()), ([ids], pa.list_(pa.int64())), ([held], pa.list_(pa.bool_())), (
                [[len(t) for t in texts]], pa.list_(pa.int64())), ([packer.compress(b"".join(texts))], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in values], names=["block", "ids", "held", "sizes", "z"])

        for b in batches:
            for i, h, t in zip(*(b.column(c) for c in ("doc_id", "held_out", "text"))):
                texts.append(shown(t.as_py().encode().lower().split()))
                ids.append(i.as_py())
                held.append(h.as_py())
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield row()
                    block += 1
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield row()

    return stored(rows.mapInArrow(pack, "block long, ids array<long>, held array<boolean>, sizes array<long>, z binary"), "texts")


def shown(words: list[bytes]) -> bytes:
    """A text's words and its end, each with a space in front."""
    return b" ".join([b"", *words, END])


class Texts:
    """Texts one after another, as ``shown``; a sequence of their words, which are made when asked for."""

    def __init__(self, data: bytes, sizes):
        self.data, self.size = data, np.asarray(sizes, np.int64)
        self.start = np.cumsum(self.size) - self.size

    @classmethod
    def of(cls, texts) -> Texts:
        if isinstance(texts, cls):
            return texts
        every = [shown(words) for words in texts]
        return cls(b"".join(every), [len(x) for x in every])

    def __len__(self) -> int:
        return len(self.size)

    def __getitem__(self, at):
        if isinstance(at, slice):
            first, last, _ = at.indices(len(self))
            size = self.size[first:last]
            begin = int(self.start[first]) if len(size) else 0
            return Texts(self.data[begin:begin + int(size.sum())], size)
        return self.data[self.start[at]:self.start[at] + self.size[at]].split()     # IndexError ends an iteration

    def chosen(self, which: np.ndarray) -> Texts:
        if which.all():
            return self
        at = np.flatnonzero(which)
        edge = zip(self.start[at].tolist(), (self.start[at] + self.size[at]).tolist())
        return Texts(b"".join([self.data[i:j] for i, j in edge]), self.size[at])


def unpacked(batch):
    """(block, ids, held, ``Texts``) of the rows of a batch."""
    import zstandard
    unpacker = zstandard.ZstdDecompressor()
    for k in range(batch.num_rows):
        block, ids, held, sizes = (batch.column(c)[k].as_py() for c in ("block", "ids", "held", "sizes"))
        texts = Texts(unpacker.decompress(batch.column("z")[k].as_py()), sizes)
        # what Arrow keeps of earlier batches is free for this block
        pa.default_memory_pool().release_unused()
        yield block, ids, held, texts


def slices(texts: Texts):
    """A block's texts, a few (``SLICE_BYTES``) at a time: where they stand. What is made of their
    windows needs room for those of a slice only, besides the different ones."""
    first, size = 0, 0
    for k, more in enumerate(texts.size.tolist()):
        size += more
        if size > SLICE_BYTES or k == len(texts) - 1:
            yield slice(first, k + 1)
            first, size = k + 1, 0


def windows(texts, order: int) -> np.ndarray:
    """Each coded byte with the bytes before it: their number (8 bits), they (the latest first, 48
    bits) and the byte (8 bits)."""
    texts = Texts.of(texts)
    raw = np.frombuffer(texts.data, np.uint8)
    # 8 bytes up to each as one number, the byte highest
    out = np.ndarray(len(raw), "<u8", bytes(7) + texts.data, strides=(1,)).astype(np.uint64)
    out &= np.uint64(((1 << 8 * order) - 1) << 56 - 8 * order)
    out |= raw
    out |= np.uint64(order << 56)
    # the first bytes of a text have fewer before them
    for depth in range(1, order):
        at = texts.start[texts.size > depth] + depth
        before = ((1 << 8 * depth) - 1) << 56 - 8 * depth
        out[at] = out[at] & np.uint64(before | 255) | np.uint64(depth << 56)
    coded = np.ones(len(raw), bool)
    coded[texts.start] = False
    return out[coded]


class Windows:
    """Windows as contexts of each order and the byte itself."""

    def __init__(self, keys: np.ndarray, order: int):
        self.symbol = (keys & np.uint64(255)).astype(np.uint8)
        self.depth = (keys >> np.uint64(56)).astype(np.int64)
        before = ((keys >> np.uint64(8)) << np.uint64(16)).byteswap()      # the latest byte lowest
        self.context = [(before & np.uint64((1 << 8 * k) - 1)) + tag(k) for k in range(order + 1)]

    def counts(self, n: np.ndarray, orders):
        """(context, symbol, n) of the contexts of some orders."""
        found = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
        for k in orders:
            has = (self.depth >= k) & (n > 0)
            if has.any():
                for into, x in zip(found, summed(self.context[k][has], self.symbol[has], n[has])):
                    into.append(x)
        return tuple(map(np.concatenate, found))


def edges(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def different(keys: np.ndarray, n: np.ndarray):
    """Equal windows added up."""
    # sorted numbers alone, then looked up, cost less than their order
    ordered = np.sort(keys)
    found = ordered[edges(ordered)]
    del ordered
    return found, np.bincount(np.searchsorted(found, keys), n, len(found)).astype(np.int64)


class Sums:
    """Windows with their numbers, added up as they come: never many more are held than are different."""

    def __init__(self):
        self.kept, self.fresh, self.size = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.fresh.append((keys, n))
        self.size += len(keys)
        if self.size > max(1 << 20, len(self.kept[0])):
            self.settled()

    def settled(self):
        """The different windows, sorted, and their numbers."""
        if self.fresh:
            keys, n = zip(self.kept, *self.fresh)
            self.kept, self.fresh, self.size = None, [], 0
            keys = np.concatenate(keys)
            self.kept = different(keys, np.concatenate(n))
        return self.kept


def trained_windows(texts, held, order: int):
    """A block's different windows, sorted, and their number in its training documents."""
    texts, held = Texts.of(texts), np.asarray(held, bool)
    own = windows(texts.chosen(~held), order)
    own.sort()
    first = edges(own)
    keys, n = own[first], np.diff(first, append=len(own))
    del own, first
    if held.any():
        other = windows(texts.chosen(held), order)
        other.sort()
        other = other[edges(other)]
        at = np.searchsorted(keys, other)
        new = at == len(keys)
        new[~new] = keys[at[~new]] != other[~new]
        keys, n = np.insert(keys, at[new], other[new]), np.insert(n, at[new], 0)
    return keys, n


def coded(keys: np.ndarray):
    """Different windows and the place of each among them. A window is sorted by what its hash and its
    place leave room for in 64 bits, which costs less than a dictionary; where two hashes agree, a
    window may come twice."""
    if not len(keys):
        return keys, np.zeros(0, np.int32)
    low = np.uint64((1 << (len(keys) - 1).bit_length()) - 1)
    at = keys * HASH & ~low
    at |= np.arange(len(keys), dtype=np.uint64)
    at.sort()
    at &= low
    at = at.view(np.int64)
    ordered = keys[at]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    index = np.empty(len(keys), np.int32)
    index[at] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return ordered[new], index


def part_of(keys: np.ndarray, order: int, parts: int) -> np.ndarray:
    """The part of each window, by the last ``SPLIT`` bytes before it."""
    last = (keys << np.uint64(8)) >> np.uint64(64 - 8 * min(SPLIT, order))
    return ((last * HASH) >> np.uint64(33)).astype(np.int64) % parts


def by_part(part: np.ndarray, parts: int):
    """(part, places of its rows in their order)."""
    # numbers of 16 bits are sorted by radix
    part = part.astype(np.uint16 if parts <= 1 << 16 else np.uint64)
    by = np.argsort(part, kind="stable")
    edge = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
    return [(int(p), by[edge[p]:edge[p + 1]]) for p in np.flatnonzero(np.diff(edge))]


def squeeze(packer, values: np.ndarray) -> bytes:
    """64-bit numbers, compressed byte place by byte place."""
    places, raw = np.empty((8, len(values)), np.uint8), np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
    for k in range(8):
        places[k] = raw[:, k]
    return packer.compress(places)


def spread(unpacker, data: bytes, kind) -> np.ndarray:
    places = np.frombuffer(unpacker.decompress(data), np.uint8).reshape(8, -1)
    out = np.empty(places.shape[::-1], np.uint8)
    for k in range(8):
        out[:, k] = places[k]
    return out.view(kind).reshape(-1)


def placed(texts):
    """A block's different words and phrases as they come; the places of the words and ends of all its
    texts, those of its phrases, the word that each phrase begins with, and the first word and the
    first phrase of each text."""
    texts = Texts.of(texts)
    raw = np.frombuffer(texts.data, np.uint8)
    space = np.flatnonzero(raw == SPACE[0])
    edge = np.append(space, len(raw))
    words = pa.Array.from_buffers(pa.large_binary(), len(space), [
        None, pa.py_buffer(edge - np.arange(len(edge))), pa.py_buffer(raw[raw != SPACE[0]])])
    last = np.flatnonzero(PHRASE_LAST[raw[edge[1:] - 1]])           # the words that end phrases
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    ends, begins = edge[last + 1], space[first] + 1
    said = [texts.data[i:j] for i, j in zip(begins.tolist(), ends.tolist())]
    # the end stands right behind the last word of its phrase
    for k in np.flatnonzero((raw[ends - 1] == END[0]) & (last > first)).tolist():
        said[k] = said[k][:-2] + END
    coded = pa.concat_arrays([words, pa.array(phrase_keys(said), pa.large_binary())]).dictionary_encode()
    index, (_, edge, data) = coded.indices.to_numpy(), coded.dictionary.buffers()
    edge, data = np.frombuffer(edge, np.int64)[:len(coded.dictionary) + 1].tolist(), data.to_pybytes()
    return [data[i:j] for i, j in pairwise(edge)], (index[:len(space)], index[len(space):], first,
                                          word := np.searchsorted(space, texts.start), np.searchsorted(first, word))


def dealt(keys: list[bytes], parts: int):
    """(part, places of its keys) by hash."""
    return by_part(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)) % np.uint64(parts), parts)


def words_of_blocks(texts: DataFrame, order: int, parts: int) -> DataFrame:
    """(block, part, words, sizes, n): the different words and phrases of each block, then its short
    contexts with their next byte, part by part, with their number in its training documents."""
    def cut(batches):
        import zstandard
        packer, least = zstandard.ZstdCompressor(level=1), min(order, SPLIT - 1)
        for b in batches:
            for block, _, held, own in unpacked(b):
                keys, (words, said, _, *firsts) = placed(own)
                known, n = ~np.array(held, bool), np.zeros(len(keys), np.int64)
                for x, first in zip((words, said), firsts):
                    n += np.bincount(x[np.repeat(known, np.diff(first, append=len(x)))], minlength=len(keys))
                if known.any():
                    few = own.chosen(known)
                    found, of = trained_windows(few, np.zeros(len(few), bool), least)
                    context, symbol, short = Windows(found, least).counts(of, range(least + 1))
                    keys += [PRECEDED + c.to_bytes(8) + bytes([x]) for c, x in zip(context.tolist(), symbol.tolist())]
                    n = np.concatenate([n, short])
                size, out = np.fromiter(map(len, keys), np.int64, len(keys)), []
                for p, at in dealt(keys, parts):
                    out.append((block, p, packer.compress(b"".join([keys[k] for k in at.tolist()])),
                                squeeze(packer, size[at]), squeeze(packer, n[at])))
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 names=["block", "part", "words", "sizes", "n"])

    return texts.mapInArrow(cut, "block long, part int, words binary, sizes binary, n binary")


COUNTED = "block long, part int, counts binary, totals array<long>, short binary, short_n binary"


def add_up(key, own):
    """A part's counts for each block in the order of its words, and a row without a block: the totals
    of ``Numbers`` and the short contexts."""
    import zstandard
    packer, unpacker = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    words, n = [], []
    for w, z, c in zip(own.column("words"), own.column("sizes"), own.column("n")):
        edge = np.concatenate([[0], np.cumsum(spread(unpacker, z.as_py(), np.int64))])
        words.append(pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [
            None, pa.py_buffer(edge), pa.py_buffer(unpacker.decompress(w.as_py()))]))
        n.append(spread(unpacker, c.as_py(), np.int64))
    coded = pa.concat_arrays(words).dictionary_encode()
    index, keys = coded.indices.to_numpy(), coded.dictionary
    total = np.bincount(index, np.concatenate(n), len(keys)).astype(np.int64)
    counts = [squeeze(packer, x) for x in np.split(total[index], np.cumsum([len(x) for x in n[:-1]]))]
    raw, edge = np.frombuffer(keys.buffers()[2], np.uint8), np.frombuffer(keys.buffers()[1], np.int64)[:len(keys) + 1]
    first = raw[edge[:-1]]
    again, short = first == SPACE[0], first == PRECEDED[0]
    of_words, of_phrases = total[~again & ~short], total[again]
    sums = [len(of_words), of_words.sum(), (of_words > 0).sum(), (of_words == 1).sum(), of_phrases.sum(), (of_phrases == 1).sum()]
    at = np.flatnonzero(short)
    rows = [*zip(own.column("block").to_pylist(), counts, *[[None] * len(n)] * 3),
            (None, None, list(map(int, sums)), b"".join(keys.take(pa.array(at)).to_pylist()), squeeze(packer, total[at]))]
    block, counts, sums, short, short_n = zip(*rows)
    return pa.table([pa.array(block, pa.int64()), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array(counts, pa.binary()),
                     pa.array(sums, pa.list_(pa.int64())), pa.array(short, pa.binary()), pa.array(short_n, pa.binary())],
                    names=[c.split()[0] for c in COUNTED.split(", ")])


def windows_of_blocks(texts: DataFrame, order: int, parts: int) -> DataFrame:
    """(block, part, keys, n): the different windows of each block, part by part."""
    def cut(batches):
        import zstandard
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for block, _, held, own in unpacked(b):
                keys, n = trained_windows(own, held, order)
                rows = [(block, p, squeeze(packer, keys[at]), squeeze(packer, n[at]))
                        for p, at in by_part(part_of(keys, order, parts), parts)]
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names=["block", "part", "keys", "n"])

    return texts.mapInArrow(cut, "block long, part int, keys binary, n binary")


def read_counts(path: str):
    """The stored (context, symbol, n) of short contexts."""
    import pyarrow.parquet as pq
    import zstandard
    from pyarrow.fs import FileSelector
    unpacker, (fs, root) = zstandard.ZstdDecompressor(), filesystem(path)
    files = [i.path for i in fs.get_file_info(FileSelector(root)) if i.base_name.startswith("part-")]
    whole = pa.concat_tables([pq.read_table(f, filesystem=fs) for f in files])
    keys = np.frombuffer(b"".join(whole["short"].to_pylist()), np.uint8).reshape(-1, 10)
    n = [spread(unpacker, x, np.int64) for x in whole["short_n"].to_pylist()]
    return np.ascontiguousarray(keys[:, 1:9]).view(">u8").reshape(-1).astype(np.uint64), keys[:, 9].copy(), np.concatenate(n)


def window_scores(keys: np.ndarray, n: np.ndarray, short, order: int) -> np.ndarray:
    """log10 probabilities of a part's different windows with their training counts."""
    w = Windows(keys, order)
    context, symbol, count = short
    asked = np.unique(np.concatenate([c[w.depth >= k] for k, c in enumerate(w.context[:SPLIT])]))
    needed = np.isin(context, asked)
    own = w.counts(n, range(SPLIT, order + 1))
    trie = Trie(np.concatenate([context[needed], own[0]]), np.concatenate([symbol[needed], own[1]]).astype(np.int64),
                np.concatenate([count[needed], own[2]]))
    return np.concatenate([trie.log10(Windows(keys[k:k + CHUNK * 10], order)) for k in range(0, len(keys), CHUNK * 10)])


def window_scores_of(texts, order: int, parts: int, sent):
    """The scores of a block's windows as they come, a slice at a time, from what the parts sent in
    order of its different ones."""
    import zstandard
    unpacker, few = zstandard.ZstdDecompressor(), []
    for at in slices(texts):
        own, index = coded(windows(texts[at], order))
        by = np.argsort(own)
        few.append((at, own[by], by.astype(np.int32), index))
    keys = np.sort(np.concatenate([own for _, own, _, _ in few]))
    keys = keys[edges(keys)]
    rated = np.empty(len(keys))
    for (p, at), (_, x) in zip(by_part(part_of(keys, order, parts), parts), sent, strict=True):
        rated[at] = spread(unpacker, x, np.float64)
    for at, own, by, index in few:
        score = np.empty(len(own))
        score[by] = rated[np.searchsorted(keys, own)]
        yield at, score[index]


def running(docs: DataFrame, order: int) -> DataFrame:
    """``score`` with contexts over the space."""
    spark = docs.sparkSession
    texts = packed(docs)
    parts = max(partitions(spark), texts.select("block").count() // BLOCKS_PER_PART)
    counts = stored(words_of_blocks(texts, order, parts).groupBy("part").applyInArrow(add_up, COUNTED), "counts")
    of_parts, of_blocks = counts.filter("block IS NULL"), counts.filter("block IS NOT NULL").select("block", "part", "counts")
    numbers = Numbers(of_parts.agg(*(F.sum(F.col("totals")[k]) for k in range(6))).first(), True)
    path = shared_dir(spark, "short-contexts")
    of_parts.select("short", "short_n").write.parquet(path)

    def rate(key, own):
        import zstandard
        packer, unpacker = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        sums = Sums()
        for k, n in zip(own.column("keys"), own.column("n")):
            sums.add(spread(unpacker, k.as_py(), np.uint64), spread(unpacker, n.as_py(), np.int64))
        kept = sums.settled()
        found = window_scores(*kept, read_counts(path), order)
        out = [squeeze(packer, found[np.searchsorted(kept[0], spread(unpacker, k.as_py(), np.uint64))]) for k in own.column("keys")]
        return pa.table([own.column("block"), own.column("part"), pa.array(out, pa.binary())], names=["block", "part", "scores"])

    rated = windows_of_blocks(texts, order, parts).groupBy("part").applyInArrow(rate, "block long, part int, scores binary")
    returned = of_blocks.unionByName(rated, allowMissingColumns=True)

    def total_up(key, own, known):
        import zstandard
        unpacker = zstandard.ZstdDecompressor()

        def got(name):
            sent = known.filter(known.column(name).is_valid()).select(["part", name])
            return sorted(zip(sent.column("part").to_pylist(), sent.column(name).to_pylist()))

        for _, ids, held, texts_ in unpacked(own):
            keys, (at, said, first, of_words, of_phrases) = placed(texts_)
            n, sent = np.empty(len(keys), np.int64), dict(got("counts"))
            for p, here in dealt(keys, parts):
                n[here] = spread(unpacker, sent[p], np.int64)[:len(here)]
            base, wordwise = numbers.scores(n)
            bytewise = []
            for few, each in window_scores_of(texts_, order, parts, got("scores")):
                data = texts_[few].data
                space = np.flatnonzero(np.frombuffer(data, np.uint8) == SPACE[0])
                # a word's windows begin behind its space; the first space of a text has none
                begin = space - np.searchsorted(texts_[few].start, space, side="right") + 1
                bytewise.append(np.add.reduceat(each, begin))
            trained = ~np.repeat(np.array(held, bool), np.diff(of_phrases, append=len(said)))
            score = numbers.by_phrase(first, n[said] - trained, wordwise[at], np.concatenate(bytewise))
            rows = zip(np.diff(of_words, append=len(at)).tolist(), np.add.reduceat((n > 0)[at].astype(np.int64), of_words).tolist(),
                       np.add.reduceat(base[at], of_words).tolist(), (np.add.reduceat(score, of_phrases) / LN).tolist())
            return scored(ids, held, rows)

    return with_total(texts.groupBy("block").cogroup(returned.groupBy("block")).applyInArrow(total_up, SCORED), numbers)
