"""Each operator against a brute-force version on odd inputs and on the smallest tables."""

import hashlib
import io
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from conftest import SF_SMALL
from llm.conftest import odd_pairs
from harness import compare, duck
from mise.llm import (components, embeddings, fingerprints, lines, minhash, packing, pieces, ppm, queries,
                      tokenfile, tokens, toxicity, warc)
from mise.llm.common import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    assert not compare(queries.QUERIES[name](spark, SF_SMALL), duck(SF_SMALL), queries.ORACLE[name])


# ---- 1 WARC

def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, key string, sha string")


def test_warc_cases(spark):
    rows = [(1, "http://a", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b", None), (4, "u", ""),
            (5, "http://c\r\nX: y", "é\r\n\r\nWARC/1.1\r\n" * 50), (6, "d", "z" * 300_000), (None, "n", "<p>one</p>"),
            (None, "n", "only here"), (7, "r", "twice"), (7, "r", "twice")]
    got = warc.round_trip(pages(spark, [(*r, "k", "s") for r in rows])).collect()
    largest = defaultdict(lambda: None)
    for i, _, html in rows:
        if i is not None:
            largest[html or ""] = max(i, largest[html or ""] or 0)
    want = Counter()
    for i, _, html in rows:
        body, top = (html or "").encode(), largest[html or ""]
        want[i, len(body), warc.digest(body), "response" if i == top else "revisit", None if i == top else top] += 1
    assert Counter(map(tuple, got)) == want
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_warc_ranges_own_each_record_once(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(k, f"http://h/{k}", "".join(rnd.choice("abc<>é ") for _ in range(rnd.randrange(400))), "", "")
            for k in range(120)]
    files = warc.write_warc(pages(spark, rows), shared_dir(spark, "warc"), file_bytes=4000)
    assert files.count() > 1 and files.agg(F.sum("records")).first()[0] == 120
    for split in (97, 1000, 1 << 20):
        got = {r["page_id"]: r["payload"] for r in warc.read_warc(files, split).filter("record_type = 'response'").collect()}
        assert all(bytes(got[i]).decode() == h for i, _, h, _, _ in rows if i in got)
        assert warc.read_warc(files, split).count() == 120


def read_ranges(data, split):
    """Page ids of an archive read in ranges, without Spark."""
    found = []
    for begin in range(0, len(data), split):
        found += warc.Range(io.BytesIO(data), len(data), begin, min(len(data), begin + split)).chains()
    return [warc.parse(x)[0]["x-page-id"] for first, stop in warc.joined(len(data), found, "archive")
            for x in warc.Range(io.BytesIO(data), len(data), first, stop).records(stop)]


def test_warc_archives_inside_payloads_are_no_records():
    """Stored, not deflated, archives in a record, one of them longer than many ranges."""
    rnd = random.Random(4)
    one = lambda k: member(warc.record(k, "u", bytes(rnd.choices(range(97, 123), k=rnd.randrange(300))), None, "d"), 6)
    inner = b"".join(map(one, range(40)))
    data = (one(8) + member(warc.record(9, "u", inner, None, "d"), 0) + one(10)
            + member(warc.record(11, "u", inner * 3, None, "d"), 0) + one(12))
    assert data.count(warc.MAGIC) >= 160
    for split in (97, 1000, len(data) // 2, 10**6):
        assert read_ranges(data, split) == ["8", "9", "10", "11", "12"]


def test_a_damaged_member_fails_alike_for_every_split(spark, tmp_path):
    rnd = random.Random(5)
    records = [member(warc.record(k, "u", bytes(rnd.choices(range(97, 123), k=rnd.randrange(300))), None, "d"), 6) for k in range(100)]
    data, at = b"".join(records), sum(map(len, records[:60]))
    for off in [0, 1, 2, *range(10, len(records[60]), 23), len(records[60]) - 1]:
        bad = bytearray(data)
        bad[at + off] ^= 0x55
        for split in (97, 500, len(data) // 4, len(data) // 2, len(data)):
            with pytest.raises(ValueError, match=f"byte {at} of"):
                read_ranges(bytes(bad), split)
    with pytest.raises(ValueError, match="byte 0 of"):
        read_ranges(b"no archive" * 50, 100)
    path = tmp_path / "bad.warc.gz"
    path.write_bytes(bytes(bad))
    files = spark.createDataFrame([(path.as_uri(), len(bad))], "uri string, size long")
    for split in (500, 10**6):
        with pytest.raises(Exception, match=f"broken gzip member at byte {at} of"):
            warc.read_warc(files, split).count()


def member(data, level):
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


# ---- 2 toxicity

def test_folding_and_exceptions():
    assert toxicity.fold("Y0u 1D10T!") == " you idiot "
    assert toxicity.fold("іdіоt") == " idiot "        # Cyrillic letters
    m = toxicity.Model({" idiot ": 2.0, " clow": 1.0, " clown ": 3.0}, [" clown fish "], (0.0, 1.0, 0.0))
    a = m.automaton()
    assert toxicity.matches(toxicity.fold("an idiot, idiot"), a)[0] == 4.0
    assert toxicity.matches(toxicity.fold("clowns"), a)[0] == 1.0
    assert toxicity.matches(toxicity.fold("clown"), a)[0] == 3.0
    assert toxicity.matches(toxicity.fold("a clown fish"), a)[0] == 0.0


def brute_matches(text, model):
    folded, total = toxicity.fold(text or ""), 0.0
    spared = [(m.start(), m.start() + len(e) - 1) for e in model.exceptions
              for m in re.finditer(f"(?={re.escape(e)})", folded)]
    for at in (m.start() for m in re.finditer(" (?=.)", folded)):
        if not any(a <= at < b for a, b in spared):
            total += max((w for t, w in model.lexicon.items() if folded.startswith(t, at)), default=0.0)
    return total


def test_toxicity_scores_and_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert set(got) == set(text)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        n = len(toxicity.fold(text[i]).split())
        total = brute_matches(text[i], model)
        x = toxicity.features(total, total / ((n if n else 1) + toxicity.SPREAD))
        z = model.curve[0] + sum(a * b for a, b in zip(model.curve[1:], x))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)
        assert r["predicted"] == (r["score"] >= 0.3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = toxicity.score(docs, toxicity.fit(docs, labels)).filter("held_out").join(labels, "doc_id").collect()
    toxic, clean = ([r["predicted"] for r in held if r["toxic"] == t] for t in (1, 0))
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.05


def test_toxicity_cases(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd, none)
    assert [r["score"] for r in toxicity.score(odd, model).collect()] == [0.0] * len(odd_pairs())
    assert toxicity.reject(odd, model).columns == odd.columns and toxicity.reject(odd, model).count() == odd.count()
    labels = spark.createDataFrame([(None, 1), (5, None), (20, 1), (20, 0), (21, 0), (99, 1)] +
                                   [(k, k % 2) for k in range(22, 32)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.score(odd, model).count() == len(odd_pairs())
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


# ---- 3 SentencePiece

@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def whole_search(m, text):
    """Viterbi over the whole text at once."""
    best, back = [0.0], [None]
    for end in range(1, len(text) + 1):
        options = [(best[end - n] + m.scores[text[end - n:end]][0], n, [m.scores[text[end - n:end]][1]])
                   for n in range(1, min(m.longest, end) + 1) if text[end - n:end] in m.scores]
        if text[end - 1] not in m.scores:
            ids = m.byte_ids(text[end - 1])
            options.append((best[end - 1] + pieces.UNKNOWN_SCORE * len(ids), 1, ids))
        top = max(options, key=lambda o: o[0])
        best.append(top[0])
        back.append(top)
    out, end = [], len(text)
    while end:
        out.append(back[end][2])
        end -= back[end][1]
    return [k for ids in reversed(out) for k in ids]


def test_streaming_search_equals_whole_search(vocabulary):
    rnd = random.Random(5)
    texts = [t for _, t in odd_pairs() if t and "▁" not in t]
    texts += ["".join(rnd.choice("thein \n日é1") for _ in range(rnd.randrange(300))) for _ in range(40)]
    for t in texts:
        escaped = "▁" + t.replace(" ", "▁")
        if t:
            assert list(vocabulary.search(escaped)) == vocabulary.encode(t) == whole_search(vocabulary, escaped)
    commits = list(vocabulary.stream("▁the▁" * 400))
    assert len(commits) > 100 and max(map(len, commits)) < 50


def test_pieces_round_trip(spark, odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = pieces.round_trip(odd, path).collect()
    assert len(got) == len(odd_pairs()) and all(r["exact"] for r in got)
    assert Counter((r["doc_id"], r["decoded_sha256"]) for r in got) == Counter(
        (i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in odd_pairs())
    back = pieces.decode(pieces.encode(odd, path), path)
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t in odd_pairs())
    assert pieces.round_trip(empty, path).count() == 0


def test_pieces_equal_the_library(spark, odd, sample):
    from sentencepiece import SentencePieceProcessor
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, rnd = SentencePieceProcessor(model_file=path), random.Random(6)
    m = pieces.pieces_of(path)
    texts = ["the windows of the relationship", "a  b   c" + " " * 40 + "d", "====----===", "the" * 300, "日本語 é\t\n"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 300)))
              for letters in ("thein \n日é1", "aeinorst", " a=-*", "internationalization ") for _ in range(100)]
    for t in texts:
        ids = library.encode(t)
        assert m.encode(t) == ids == list(m.search("▁" + t.replace(" ", "▁")))
    commits = list(m.stream("▁the" * 400))
    assert len(commits) > 50 and max(map(len, commits)) < 50
    for df in (odd, sample):
        want = Counter((r["doc_id"], tuple(library.encode(r["text"] or ""))) for r in df.collect() if "▁" not in (r["text"] or ""))
        got = Counter((r["doc_id"], tuple(r["ids"])) for r in pieces.encode(df, path).collect())
        assert want and not want - got


# ---- 4 line dedup

def brute_lines(pairs, min_docs):
    keys = lambda t: [lower(x.strip(lines.STRIPPED)) for x in (t or "").split("\n")]
    found = Counter(k for _, t in pairs for k in set(keys(t)))
    out = []
    for i, t in pairs:
        gone = [bool(k) and found[k] >= min_docs for k in keys(t)]
        kept = "\n".join(x for x, g in zip((t or "").split("\n"), gone) if not g)
        out.append((i, len(gone), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("min_docs", [2, 10])
def test_common_lines(odd, min_docs):
    assert Counter(map(tuple, lines.digests(odd, min_docs).collect())) == brute_lines(odd_pairs(), min_docs)


def test_line_runs_over_many_batches(spark, empty):
    assert lines.digests(empty).count() == 0
    runs, total, rnd = lines.LineRuns(spark, min_docs=4, fanout=2), Counter(), random.Random(1)
    for _ in range(7):
        batch = Counter(rnd.randrange(30) for _ in range(25))
        total.update(batch)
        runs.add(spark.createDataFrame([(k, -k, n) for k, n in batch.items()], "h1 long, h2 long, n long"))
    assert len(runs.runs()) <= 3
    assert {r["h1"] for r in runs.common().collect()} == {k for k, n in total.items() if n >= 4}


# ---- 5 embeddings

def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((60, 16))
    near = base[:20] + 0.22 * rng.standard_normal((20, 16))
    chain = np.cumsum(0.25 * rng.standard_normal((30, 16)), axis=0) + 4
    x = np.concatenate([base, near, np.repeat(base[:1], 40, axis=0), 3 * base[1:2], chain])
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None]),
             (905, [float("inf")] + [1.0] * 15), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, rows[0][1]), (908, [1e200] * 16)]
    df = spark.createDataFrame([(i, v, 1, "k", 2) for i, v in rows],
                               "vec_id long, embedding array<double>, label int, key string, node int")
    good = {k: np.array(v) for k, (_, v) in enumerate(rows)
            if v and None not in v and np.isfinite(v).all() and 0 < max(map(abs, v)) < 1e150}
    links = defaultdict(set)
    for p in good:
        for q in good:
            if p < q and len(good[p]) == len(good[q]):
                a, b = good[p], good[q]
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                    links[p].add(q)
                    links[q].add(p)
    want = Counter()
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        least = min((rows[s][0] for s in seen if rows[s][0] is not None), default=None)
        want[i, len(links[k]), least, i == least] += 1
    assert Counter(map(tuple, embeddings.near_duplicates(df, miss=1e-9, block=16).collect())) == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_code_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    u = rng.standard_normal((400, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    v = 0.9 * u + math.sqrt(1 - 0.81) * np.roll(u, 1, axis=0)
    v /= np.linalg.norm(v, axis=1)[:, None]
    turned = embeddings.rotated(u, 2)
    f, signs = embeddings.factors(turned), np.sign(turned) / 8
    estimate = (signs * embeddings.rotated(v, 2)).sum(axis=2) / f
    off = (estimate - (u * v).sum(axis=1)[:, None]) / embeddings.error(f, 64)
    assert abs(off.mean()) < 0.1 and np.abs(off).max() < embeddings.SIGMAS


# ---- 6 language model

def slow_trie_score(words, counts, order):
    """log10 probability of words under the trie, context by context with dictionaries."""
    next_ = defaultdict(Counter)
    for w, c in counts.items():
        unit = b" " + w + (b"" if w == b"\n" else b" ")
        for at in range(1, len(unit)):
            for k in range(min(at, order) + 1):
                next_[unit[at - k:at]][unit[at]] += c
    out = []
    for w in words:
        unit, total = b" " + w + (b"" if w == b"\n" else b" "), 0.0
        for at in range(1, len(unit)):
            p, gone = 1.0, set()
            for k in range(min(at, order), -1, -1):
                own = next_.get(unit[at - k:at])
                if not own:
                    continue
                left = {s: n for s, n in own.items() if s not in gone}
                room = sum(left.values()) + len(left)
                if unit[at] in left:
                    p *= left[unit[at]] / room
                    break
                if left:
                    p *= len(left) / room
                gone |= set(own)
            else:
                p *= 1 / (256 - len(gone))
            total += math.log10(p)
        out.append(total)
    return out


def test_trie_equals_slow_trie():
    rnd = random.Random(4)
    counts = Counter("".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 9))).encode() for _ in range(300))
    counts[b"\n"] = 20
    for order in (2, 6):
        p = ppm.Positions(list(counts), order)
        n = np.array(list(counts.values()))[p.word]
        parts = [ppm.summed(p.context[k][p.depth >= k], p.symbol[p.depth >= k], n[p.depth >= k]) for k in range(order + 1)]
        trie = ppm.Trie(*(np.concatenate(x) for x in zip(*parts)))
        words = [*list(counts)[:50], b"zebra", b"abcdz", b"\xff\x00", b"aaaaaaaaaaaaa"]
        assert np.allclose(ppm.word_scores(words, trie, order), slow_trie_score(words, counts, order))


def test_language_model_against_brute_force(spark, odd):
    pairs = odd_pairs()
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in pairs]
    toks = [[w.encode() for w in WORD.findall(lower(t))] for _, t in pairs]
    counts, phrases_ = Counter(), Counter()
    for h, t in zip(held, toks):
        if not h:
            counts.update([*t, b"\n"])
            phrases_.update(ppm.phrases(t))
    n, v = sum(counts.values()), len(counts)
    every = sorted({w for t in toks for w in t} | {b"\n"})
    bytewise = dict(zip(every, slow_trie_score(every, counts, ppm.ORDER)))
    e = (sum(c == 1 for c in counts.values()) + 1) / (n + 2)
    word = {w: math.log10((1 - e) * counts[w] / n + e * 10 ** bytewise[w]) if bytewise[w] > -300 or counts[w]
            else math.log10(e) + bytewise[w] for w in every}
    n_phrases = sum(phrases_.values())
    escape = (sum(c == 1 for c in phrases_.values()) + 1) / (n_phrases + 2)
    want = []
    for (i, _), h, t in zip(pairs, held, toks):
        score, own = 0.0, ppm.phrases(t)
        for x in own:
            parts = x.removesuffix(b"\n").split() + ([b"\n"] if x.endswith(b"\n") else [])
            whole, by_words = (1 - escape) * (phrases_[x] - (not h)) / n_phrases, sum(word[w] for w in parts)
            score += np.logaddexp(math.log(whole) if whole > 0 else -math.inf,
                                  math.log(escape) + by_words * math.log(10)) / math.log(10)
        all_ = [*t, b"\n"]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in all_)
        want.append((i, h, len(all_), sum(counts[w] > 0 for w in all_), n, round(base, 6), round(score, 6)))
    got = [(*r[:5], round(r[5], 6), round(r[6], 6)) for r in ppm.score(odd, words_per_block=300).collect()]
    order = lambda r: (str(r[0]), *map(float, r[1:]))
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=order), sorted(want, key=order)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-4)


def test_contexts_reach_over_the_space(spark):
    """Bytes against whole texts context by context; and the order of words counts."""
    rnd = random.Random(12)
    text = lambda n: [rnd.choice(["ab", "abc", "c", "bca", "ca"]).encode() for _ in range(n)]
    known, asked = [text(rnd.randrange(12)) for _ in range(60)], [text(7), [b"zz", b"c"], []]
    n = Counter(u for t in known for u in ppm.units(t, ppm.ORDER))
    p = ppm.Positions(list(n), ppm.ORDER)
    counts = np.array(list(n.values()))[p.word]
    parts = [ppm.summed(p.context[k][p.depth >= k], p.symbol[p.depth >= k], counts[p.depth >= k])
             for k in range(ppm.ORDER + 1)]
    trie = ppm.Trie(*(np.concatenate(x) for x in zip(*parts)))
    # a whole text with its end as one word of the slow trie, less the space that closes a word
    whole = Counter(b" ".join([*t, b"\n"]) for t in known)
    next_ = defaultdict(Counter)
    for t, c in whole.items():
        for at in range(1, len(t) + 1):
            for k in range(min(at, ppm.ORDER) + 1):
                next_[(b" " + t)[at - k:at]][(b" " + t)[at]] += c
    assert {int(sum(trie.n)), sum(map(len, next_.values()))} == {sum(sum(x.values()) for x in next_.values()), len(trie.n)}
    for t in asked:
        raw, want = b" " + b" ".join([*t, b"\n"]), 0.0
        for at in range(1, len(raw)):
            q, gone = 1.0, set()
            for k in range(min(at, ppm.ORDER), -1, -1):
                left = {s: c for s, c in next_.get(raw[at - k:at], {}).items() if s not in gone}
                room = sum(left.values()) + len(left)
                if raw[at] in left:
                    q *= left[raw[at]] / room
                    break
                if left:
                    q *= len(left) / room
                gone |= set(left)
            else:
                q *= 1 / (256 - len(gone))
            want += math.log10(q)
        assert ppm.word_scores(ppm.units(t, ppm.ORDER), trie, ppm.ORDER).sum() == pytest.approx(want)
    words = ["green", "apples", "fall", "slowly", "under", "old", "trees"]
    held = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    rows = [(i, " ".join(words)) for i in range(30) if zlib.crc32(str(i).encode()) % 10]
    rows += [(held[0], " ".join([*words, "today"])), (held[1], " ".join([*words[::-1], "today"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same, turned = ({r["doc_id"]: r["score"] for r in ppm.score(docs, words_per_block=5, across=True).collect()}[i] for i in held)
    assert same > turned + 1


def test_windows_equal_units_and_parts_the_whole(monkeypatch):
    """Windows are the units' bytes and contexts; parts score theirs as one trie of all does."""
    rnd = random.Random(21)
    texts = [[rnd.choice(["ab", "abc", "c", "bca", "é"]).encode() for _ in range(rnd.randrange(30))] for _ in range(40)]
    held = [k % 5 == 0 for k in range(40)]
    monkeypatch.setattr(ppm, "SLICE_BYTES", 100)
    for order in (2, 6):
        w, p = ppm.Windows(ppm.windows(texts, order), order), ppm.Positions([u for t in texts for u in ppm.units(t, order)], order)
        assert (w.symbol == p.symbol).all() and (w.depth == p.depth).all()
        assert all((x[p.depth >= k] == y[p.depth >= k]).all() for k, (x, y) in enumerate(zip(w.context, p.context)))
        known = [t for t, h in zip(texts, held) if not h]
        q = ppm.Positions([u for t in known for u in ppm.units(t, order)], order)
        one = np.ones(len(q.symbol), np.int64)
        counts = [ppm.summed(q.context[k][q.depth >= k], q.symbol[q.depth >= k], one[q.depth >= k]) for k in range(order + 1)]
        whole = ppm.Trie(*(np.concatenate(x) for x in zip(*counts)))
        short = tuple(np.concatenate(x) for x in zip(*counts[:ppm.SPLIT]))
        blocks = [ppm.trained_windows(texts[k:k + 10], held[k:k + 10], order) for k in range(0, 40, 10)]
        keys, n = ppm.different(*map(np.concatenate, zip(*blocks)))
        part = ppm.part_of(keys, order, 7)
        assert len(set(part)) > 1
        for k in set(part):
            own = keys[part == k]
            assert np.allclose(ppm.window_scores(own, n[part == k], short, order), whole.log10(ppm.Windows(own, order)))


def test_a_block_is_placed_without_steps_for_each_word_or_text():
    """Words and phrases stand where those of each text stand; a Python call is made for each phrase at most."""
    rnd = random.Random(31)
    some = [b"ab", b"c.", b"no!", "\u00e9?".encode(), b".", b"\x00", b"\xff\x00x", "\u00a0".encode(), b"a\x1fb"]
    texts = [[rnd.choice(some) for _ in range(rnd.choice([0, 1, 2, 9, 40]))] for _ in range(300)]
    block, calls = ppm.Texts.of(texts), Counter()
    assert list(block) == texts and list(block[7:11]) == texts[7:11] and list(block[300:]) == []
    assert list(block.chosen(np.arange(300) % 3 == 1)) == texts[1::3]
    ppm.placed(block)       # what is imported at first use
    before = sys.getprofile()
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        keys, (words, said, first, of_words, of_phrases) = ppm.placed(block)
    finally:
        sys.setprofile(before)
    assert len(set(keys)) == len(keys)
    assert [keys[k] for k in words] == [w for t in texts for w in [*t, ppm.END]]
    assert [keys[k] for k in said] == [x for t in texts for x in ppm.phrase_keys(ppm.phrases(t))]
    assert np.diff(first, append=len(words)).tolist() == [x for t in texts for x in ppm.phrase_sizes(ppm.phrases(t))]
    assert np.diff(of_words, append=len(words)).tolist() == [len(t) + 1 for t in texts]
    assert np.diff(of_phrases, append=len(said)).tolist() == [len(ppm.phrases(t)) for t in texts]
    assert calls["c_call"] + calls["call"] < 2 * len(said) + 300
    one = ppm.Texts.of([])
    assert len(ppm.windows(one, 6)) == 0 and len(ppm.trained_windows(one, [], 6)[0]) == 0


def test_windows_are_told_apart_whatever_their_hashes(monkeypatch):
    rnd = random.Random(32)
    texts = [[rnd.choice(["ab", "abc", "c", "\x00", "\u00e9"]).encode() for _ in range(rnd.randrange(30))] for _ in range(60)]
    held = [k % 4 == 0 for k in range(60)]
    for hash_ in (int(ppm.HASH), 1, 1 << 60, 0):
        monkeypatch.setattr(ppm, "HASH", np.uint64(hash_))
        for some in (texts, texts[:1], [[]]):
            keys = ppm.windows(some, 6)
            own, index = ppm.coded(keys)
            assert (own[index] == keys).all() and set(own.tolist()) == set(keys.tolist())
    assert len(ppm.coded(keys[:0])[0]) == 0
    for which in (held, [True] * 60, [False] * 60):
        want = Counter(ppm.windows(texts, 6).tolist())
        want.subtract(ppm.windows([t for t, h in zip(texts, which) if h], 6).tolist())
        got, n = ppm.trained_windows(texts, which, 6)
        assert dict(zip(got.tolist(), n.tolist())) == want and (np.diff(got.astype(object)) > 0).all()


def test_words_are_sent_by_block_and_part(spark, sample):
    """A block's words go as one row for each part, not a row for each word, and come back added up."""
    texts = ppm.packed(sample.repartition(5))
    own = [x for r in texts.collect() for x in ppm.unpacked(pa.RecordBatch.from_pylist([{k: bytes(v) if k == "z" else v for k, v in r.asDict().items()}]))]
    sent = ppm.words_of_blocks(texts, ppm.ORDER, 3)
    assert len(own) == 5 and sent.count() <= 5 * 3
    words, said = Counter(), Counter()
    for _, _, held, rows in own:
        for t, h in zip(rows, held):
            words.update({w: 0 for w in [*t, ppm.END]} if h else [*t, ppm.END])
            said.update({x: 0 for x in ppm.phrases(t)} if h else ppm.phrases(t))
    rows = sent.groupBy("part").applyInArrow(ppm.add_up, ppm.COUNTED).collect()
    totals = np.array([r["totals"] for r in rows if r["block"] is None]).sum(axis=0).tolist()
    some = [c for c in words.values() if c], [c for c in said.values() if c]
    assert totals == [len(words), sum(some[0]), len(some[0]), some[0].count(1), sum(some[1]), some[1].count(1)]
    unpacker = zstandard.ZstdDecompressor()
    for block, _, _, texts_ in own:
        keys, _ = ppm.placed(texts_)
        counts = {r["part"]: ppm.spread(unpacker, bytes(r["counts"]), np.int64) for r in rows if r["block"] == block}
        got = {keys[k]: int(x) for p, at in ppm.dealt(keys, 3) for k, x in zip(at, counts[p])}
        want = {**words, **{k: said[x] for x, k in zip(said, ppm.phrase_keys(list(said)))}}
        assert got == {k: want[k] for k in keys}


def test_scores_over_the_space_do_not_depend_on_blocks(spark, odd):
    rows = odd.select("doc_id", "text")
    first, second = ([(r[0], *r[1:5], round(r[5], 6), round(r[6], 6)) for r in ppm.score(d, across=True).collect()]
                     for d in (rows.repartition(1), rows.repartition(7)))
    assert Counter(first) == Counter(second) and len(first) == len(odd_pairs())
    counts = Counter(w for i, t in odd_pairs() if i is None or zlib.crc32(str(i).encode()) % 10 for w in [*(t or "").encode().lower().split(), b"\n"])
    assert {r[4] for r in first} == {sum(counts.values())}


def test_language_model_beats_its_base_on_held_out_texts(spark, empty):
    rows = ppm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert ppm.score(empty).count() == 0


def test_contexts_over_the_space_score_higher(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    within, over = ({r["doc_id"]: r for r in d.filter("held_out").collect()} for d in (
        ppm.score(docs), queries.op6_ppm(spark, "/root/testdata/sf0.01")))
    assert all(within[i][:6] == pytest.approx(over[i][:6]) for i in within) and set(within) == set(over)
    assert sum(r["score"] for r in over.values()) > sum(r["score"] for r in within.values())
    assert ppm.score(empty, across=True).count() == 0


# ---- 7 fingerprints

def slow_features(raw, rank):
    """Selected windows' hashes, window by window, in plain integers."""
    raw, out, big = bytes(raw), [], 2**64
    if not raw:
        return []

    def hash_(w):
        words = [int.from_bytes(w[k:k + 8], "little") for k in range(0, len(w), 8)]
        h = sum(x * int(m) for x, m in zip(words, fingerprints.MULTIPLIERS)) % big
        h = (h ^ h >> 32) * 0x9E3779B97F4A7C15 % big
        return h ^ h >> 29

    def gram(i):
        x = int.from_bytes(raw[i:i + 4], "little") * 2654435761 % 2**32
        return (x ^ x >> 15) * 2246822519 % 2**32

    def level(w):
        f = [round(c * math.log2(c) * 2**20) if c else 0 for c in range(len(w) + 1)]
        return min((f[len(w)] - sum(f[c] for c in Counter(w).values())) * 1000 // f[len(w)], 999)
    if len(raw) < 16:
        return [hash_(raw.ljust(16, b"\0"))]
    for width, first in [(16, 1000)] * (len(raw) < 512) + [(64, 0)] * (len(raw) >= 256):
        n, run = len(raw) - width + 1, 32
        order = [int(rank[first + level(raw[k:k + width])]) << 32 | gram(k) for k in range(n)]
        while run > n:
            run //= 2
        wins = {j for a in range(n - run + 1) for j in range(a, a + run) if order[j] == min(order[a:a + run])}
        out += [hash_(raw[k:k + width]) for k in sorted(wins)]
    return list(dict.fromkeys(out))


def slow_chain(features):
    return [{(h >> 11 * k) % 2048 for h in features[at:at + 160] for k in range(5)} for at in range(0, len(features), 160)]


def slow_likeness(x, y):
    if not x or not y:
        return float(len(x) == len(y))
    if len(x) > len(y):
        x, y = y, x

    def one(a, b):
        chance, most = len(a) * len(b) / 2048, min(len(a), len(b))
        if most - chance < 1e-6:
            return float(len(a & b) >= most)
        return min(max((len(a & b) - chance) / (most - chance), 0), 1)
    return sum(max(one(a, b) for b in y) for a in x) / len(x)


def test_fingerprints_against_brute_force(monkeypatch):
    monkeypatch.setattr(fingerprints, "COMPARED", 2)
    rnd = random.Random(8)
    rank = fingerprints.ranks(np.array([rnd.randrange(40) for _ in range(2000)]))
    text = lambda n: "".join(rnd.choice("abcdefgh \n") for _ in range(n))
    texts = [text(n) for n in (0, 3, 15, 16, 60, 255, 256, 511, 512, 700)] + [text(9000), text(9000)]
    texts += [fingerprints.edited(texts[-1], texts[-2]), "ab" * 400]
    chains = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        want = slow_features(raw, rank)
        assert fingerprints.selected(raw, rank, fingerprints.all_levels(raw)).tolist() == want
        chains.append((fingerprints.fingerprint(raw, rank), slow_chain(want)))
        assert [set(np.flatnonzero(np.unpackbits(f))) for f in chains[-1][0]] == chains[-1][1]
    for x, a in chains:
        for y, b in chains[::3]:
            assert fingerprints.likeness(x, y) == pytest.approx(slow_likeness(a, b), abs=1e-5)


def test_levels_of_an_edited_text_are_carried_over():
    rnd = random.Random(18)
    for n in (10, 50, 250, 300, 520, 900, 2000):
        t, other = ("".join(rnd.choice("abcdéf \n") for _ in range(n)) for _ in range(2))
        raw, new = (np.frombuffer(x.encode(), np.uint8) for x in (t, fingerprints.edited(t, other)))
        same = len(t[:n - n // 3].encode())
        got, want = fingerprints.all_levels(new, fingerprints.all_levels(raw), same), fingerprints.all_levels(new)
        assert got.keys() == want.keys() and all((got[w] == want[w]).all() for w in want)


def test_ranks_do_not_hang_on_the_table_size():
    n = np.array([5, 0, 7, 5, 10**6])
    assert fingerprints.ranks(n).tolist() == [1, 0, 2, 1, 3] == fingerprints.ranks(n * 10**9).tolist()


def test_every_window_is_ranked(spark, sample):
    rnd = random.Random(9)
    for n in (16, 17, 63, 64, 200, 300, 700):
        raw = np.frombuffer("".join(rnd.choice("abcdefgh \n") for _ in range(n)).encode(), np.uint8)
        for width, _ in fingerprints.kinds(raw):
            level = fingerprints.levels(raw, width)
            assert len(level) == n - width + 1
            for at, own in enumerate(level):
                c = np.bincount(raw[at:at + width])
                c = c[c > 0] / width
                assert abs(own - -(c * np.log2(c)).sum() / math.log2(width) * 1000) <= 1
    texts = [r["text"].encode() for r in sample.select("text").collect() if r["text"]]
    count = lambda width, keep: sum(max(len(t) - width + 1, 0) for t in texts if keep(len(t)))
    n = fingerprints.rarities(sample)
    assert n[:1000].sum() == count(64, lambda k: k >= 256) and n[1000:].sum() == count(16, lambda k: k < 512)
    # the improbable windows of a text give a feature, wherever they are
    rarity = np.full(2000, 10**6)
    rarity[999] = 1
    for at in range(300, 340):
        raw = np.frombuffer(b"ab" * 400, np.uint8).copy()
        raw[at:at + 64] = np.arange(100, 164)
        rare = np.flatnonzero(fingerprints.levels(raw, 64) == 999)
        assert at in rare and len(rare) < 6
        assert {int(fingerprints.hashes(raw[k:k + 64][None])[0]) for k in rare} & set(
            fingerprints.selected(raw, fingerprints.ranks(rarity), fingerprints.all_levels(raw)).tolist())


def test_short_texts_keep_features_of_their_unchanged_part(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rank = fingerprints.ranks(fingerprints.rarities(docs))
    texts = [r["text"] for r in docs.collect() if r["text"] and 96 <= len(r["text"]) < 1000]
    lost = 0
    for t, following in zip(texts, texts[1:] + texts[:1]):
        raws = (np.frombuffer(x.encode(), np.uint8) for x in (t, fingerprints.edited(t, following)))
        a, b = (set(fingerprints.selected(raw, rank, fingerprints.all_levels(raw)).tolist()) for raw in raws)
        lost += not a & b
    assert len(texts) > 20 and lost == 0


def test_fingerprints_of_neighbours(odd, sample, empty):
    for df in (odd, sample):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()),
                      key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        rank = fingerprints.ranks(fingerprints.rarities(df))
        want = Counter()
        print_ = lambda t: fingerprints.fingerprint(np.frombuffer(t.encode(), np.uint8), rank)
        for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
            k = len(t) // 3
            new = t[:len(t) - k] + following[:k]
            a, b, c = print_(t), print_(new), print_(following)
            want[i, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprints.text_of(a), fingerprints.text_of(b),
                 round(fingerprints.likeness(a, b), 9), round(fingerprints.likeness(a, c), 9)] += 1
        got = Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in fingerprints.fingerprints(df).collect())
        assert got == want
    assert fingerprints.fingerprints(empty).count() == 0


def test_likeness_tells_edits_from_strangers(sample):
    rows = fingerprints.fingerprints(sample.filter("n_chars > 500")).collect()
    assert np.median([r["near_edited"] for r in rows]) > 0.4 > 0.2 > np.median([r["near_next"] for r in rows])


# ---- 8 MinHash

def brute_groups(pairs, width, percent=80):
    sets = []
    for _, t in pairs:
        w = WORD.findall(lower(t))
        n = min(width, len(w))
        sets.append({tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set())
    group = list(range(len(pairs)))
    for a in range(len(pairs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return sets, group


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(odd, width):
    pairs = odd_pairs()
    sets, group = brute_groups(pairs, width)
    want = Counter()
    for (i, _), s, g in zip(pairs, sets, group):
        ids = [p[0] for p, h in zip(pairs, group) if h == g and p[0] is not None]
        least = (min(ids) if ids else None) if s else i
        want[i, len(s), least, i == least] += 1
    assert Counter(map(tuple, minhash.near_duplicates(odd, width).collect())) == want


def test_chains_and_shared_passages(spark):
    """Links through a chain, and many texts that share a passage but are no near copies."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    chain = [[word() for _ in range(60)]]
    for _ in range(25):
        new = list(chain[-1])
        for _ in range(2):
            new[rnd.randrange(60)] = word()
        chain.append(new)
    passage = [word() for _ in range(40)]
    pairs = [(k, " ".join(w)) for k, w in enumerate(chain)]
    pairs += [(100 + k, " ".join(passage + [word() for _ in range(rnd.randrange(6, 20))])) for k in range(60)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    sets, group = brute_groups(pairs, 2)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 2).collect()}
    for (i, _), g in zip(pairs, group):
        assert got[i] == min(p[0] for p, h in zip(pairs, group) if h == g)


def test_estimate_is_close():
    rng = np.random.default_rng(9)
    x = [np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64) * np.uint64(2)) for _ in range(80)]
    y = [np.unique(np.concatenate([rng.choice(s, 800, replace=False), rng.choice(t, 100, replace=False)]))
         for s, t in zip(x, reversed(x))]
    truth = np.array([len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in zip(x, y)])
    n = np.full(80, 900.0)
    j, error = minhash.estimate(minhash.registers(x), minhash.registers(y), n, n)
    assert abs((j - truth).mean()) < 0.02 and (np.abs(j - truth) < 5 * error).all()


def test_keep_one(odd, empty):
    pairs = odd_pairs()
    sets, group = brute_groups(pairs, 5)
    kept = minhash.keep_one(odd)
    assert kept.schema == odd.schema
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    blank = Counter(p for p, s in zip(pairs, sets) if not s)
    assert all(got[p] == n for p, n in blank.items())
    place = {p: g for p, g, s in zip(pairs, group, sets) if s}
    assert sorted(place[p] for p in got.elements() if p in place) == sorted({g for g, s in zip(group, sets) if s})
    assert minhash.keep_one(empty).count() == 0 and minhash.near_duplicates(empty).count() == 0


def test_rounds_read_only_links_that_are_left(spark, monkeypatch):
    """A large group's links are read once, not again in every round."""
    sizes, keep = [], components.stored

    def counted(df, name):
        out = keep(df, name)
        if name == "links":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(components, "stored", counted)
    links = [(a, b) for a in range(20) for b in range(20, 120)] + [(k, k + 1) for k in range(1000, 1040)] + [(1020, 5)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {k: 0 for k in [*range(120), *range(1000, 1041)]}
    assert sizes[0] == len(links) and sizes[-1] == 0 and sum(sizes[1:]) < len(links) / 10


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (103, 101), (7, 3), (200, 200)]
    df = spark.createDataFrame(links, "a long, b long")
    got = dict(components.components(df).collect())
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 103: 100}


# ---- 9 and 10 tokens

@pytest.mark.parametrize("name, style", [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "dropped")])
def test_piecewise_ids_equal_whole_ids(name, style):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    enc = tokens.Encoder(public_tokenizers.path(name), style)
    rnd = random.Random(7)
    texts = [t or "" for _, t in odd_pairs()]
    texts += ["".join(rnd.choice("ab1!' \n\t\x1c\x85\xa0é́▁") for _ in range(rnd.randrange(200))) for _ in range(300)]
    texts += ["", " ", "  ", "a  b   c", " it's  <|endoftext|> we'll", "Á b́", "ΑΣ ΑΣ.", "x  y  z"]
    assert [list(x) for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    # a bound that is met at once: what is forgotten is encoded again
    enc.cache_bytes = 1
    assert all(list(enc.encode([t])[0]) == tok.encode(t, add_special_tokens=False).ids for t in texts) and not enc.long


def test_words_are_encoded_once_whatever_follows_them():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc, asked = Tokenizer.from_file(path), tokens.Encoder(path, "spaced"), []
    fresh = enc.fresh
    enc.fresh = lambda pieces: asked.extend(pieces) or fresh(pieces)
    text = "x wordone wordone. wordone, wordone;\nwordone\nÉtés Étés. wordone's wordone.$$ wordone\n\nwordone \n wordone" + "y" * 70 + ".\nend"
    assert list(enc.encode([text])[0]) == tok.encode(text, add_special_tokens=False).ids
    assert asked.count(" wordone") == 1 and not [w for w in asked if w.startswith(" wordone") and w[8:9] in set(".,;\n")]
    assert not enc.long and all(len(w) <= tokens.LONGEST_KEPT for w in enc.young)
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("abÉ1²²'s.,!#\n\n \t\r\u0301\u4e00<|>_-") for _ in range(rnd.randrange(120))) for _ in range(3000)]
    assert [list(x) for x in enc.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def whole_ids(pairs, name, end):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return [(i, t or "", tok.encode(t or "", add_special_tokens=False).ids + [end]) for i, t in pairs]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, odd, empty):
    want, start = [], 0
    for i, _, ids in sorted(whole_ids(odd_pairs(), "byte_bpe_50k.json", 2),
                            key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = tokenfile.round_trip(odd, path).orderBy("start").collect()
    assert list(map(tuple, got)) == want
    files = tokenfile.write_ids(odd, shared_dir(spark, "ids"), path, length=64)
    total = 0
    for r in files.collect():
        f = tokenfile.open_sequences(r["ids_uri"])
        batches = [f.get_batch(k) for k in range(f.num_record_batches)]
        assert all(b.schema.field("ids").type.list_size == 64 for b in batches)
        total += sum(int(b.column("mask").flatten().to_numpy(zero_copy_only=False).sum()) for b in batches)
    assert total == start
    assert tokenfile.round_trip(empty, path).count() == 0


def test_packing(odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = whole_ids(odd_pairs(), "word_bpe_49k.json", 1)
    for capacity in (16, 4096):
        want = Counter((i, k // capacity, k, len(ids[k:k + capacity]), crc(ids[k:k + capacity]))
                       for i, _, ids in docs for k in range(0, len(ids), capacity))
        got = packing.pack(odd, path, capacity).collect()
        assert Counter(tuple(r[:5]) for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in by.values():
            ends = [a + n for a, n in sorted(own)]
            assert [a for a, _ in sorted(own)] == [0, *ends[:-1]] and ends[-1] <= capacity
        assert len(by) == len(slow_best_fit([r["length"] for r in got], capacity))
    assert packing.pack(empty, path).count() == 0


def slow_best_fit(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= n
        else:
            left.append(capacity - n)
    return left


def test_plan_equals_best_fit_decreasing():
    rnd = random.Random(10)
    for _ in range(60):
        capacity = rnd.choice([7, 64, 100])
        lengths = [rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(1, 400))]
        runs = packing.plan(Counter(lengths), capacity)
        fill, count = defaultdict(int), Counter()
        for length, first, last, per, sequence, offset in runs:
            for k in range(last - first):
                at = sequence + k // per
                assert fill[at] == offset + k % per * length
                fill[at] += length
            count[length] += last - first
        assert count == Counter(lengths) and max(fill.values()) <= capacity
        assert sorted(capacity - v for v in fill.values()) == sorted(slow_best_fit(lengths, capacity))
