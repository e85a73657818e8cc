"""Quality rules, conversation repair and spelling variants against brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm.conftest import odd_pairs
from mise.llm import conversations as C
from mise.llm import quality as Q
from mise.llm import spelling as S
from mise.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- 11 quality rules

def slow_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    found = Counter(windows)
    again = {p for k, w in enumerate(windows) if found[w] > 1 for p in range(k, k + 5)}
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


def slow_model(texts):
    """{level: {gram: p}} and {level: {context: rest}} by dictionaries."""
    full = Counter()
    for t in texts:
        s = (Q.START,) * (Q.ORDER - 1) + tuple(map(ord, t))
        full.update(s[k:k + Q.ORDER] for k in range(len(s) - Q.ORDER + 1))
    counts = {Q.ORDER: full}
    for k in range(Q.ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    p, rests = {0: {(): Q.UNIFORM}}, {}
    for k in range(1, Q.ORDER + 1):
        n = Counter(counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [0] + [min(j, max(Q.LEAST_DISCOUNT, j - (j + 1) * y * n[j + 1] / n[j] if n[j] else y)) for j in (1, 2, 3)]
        total, left = Counter(), Counter()
        for g, c in counts[k].items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        rests[k - 1] = {x: left[x] / total[x] for x in total}
        p[k] = {g: (c - d[min(c, 3)]) / total[g[:-1]] + rests[k - 1][g[:-1]] * p[k - 1].get(g[1:], 0) if k > 1
                else (c - d[min(c, 3)]) / total[()] + rests[0][()] * Q.UNIFORM for g, c in counts[k].items()}
    return p, rests


def slow_log_p(text, p, rests):
    s = (Q.START,) * (Q.ORDER - 1) + tuple(map(ord, text))

    def one(g):
        if not g:
            return Q.UNIFORM
        return p[len(g)][g] if g in p[len(g)] else rests[len(g) - 1].get(g[:-1], 1.0) * one(g[1:])
    return sum(math.log10(one(s[k:k + Q.ORDER])) for k in range(len(s) - Q.ORDER + 1))


@pytest.fixture()
def short_stretches(monkeypatch):
    monkeypatch.setattr(Q, "STRETCH", 50)
    monkeypatch.setattr(S, "STRETCH", 50)


def test_counts_of_words_and_lines(short_stretches):
    rnd = random.Random(2)
    texts = [t for _, t in odd_pairs()] + [" ".join(rnd.choice("ab") for _ in range(n)) for n in (4, 5, 9, 40, 300)]
    texts += ["a b\na b\n\n \na b ", "#|x|# <b>&amp;</b> 100%\x0b$*", "    x"]
    for t in texts:
        assert Q.base(t or "") == slow_base(t)


def test_words_are_cut_at_their_blanks_only(short_stretches):
    rnd = random.Random(8)
    for n in [0, 1, 3, *range(5, 120, 5)]:
        text = "".join(rnd.choice("aé\u4e00\U0001f600 \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u2003\u2028") for _ in range(n))
        assert Q.base(text) == slow_base(text)


def test_keys_are_found_in_a_few_looks():
    """Lookups are by hash, not by a search over all sorted keys."""
    rnd = np.random.default_rng(9)
    for keys in (np.empty(0, np.uint64), np.arange(1, dtype=np.uint64), np.arange(70_000, dtype=np.uint64) << np.uint64(21),
                 np.unique(rnd.integers(0, 1 << 52, 50_000).astype(np.uint64)), np.arange(3000, dtype=np.uint64) * np.uint64(1 << 40)):
        places = Q.Places(keys)
        asked = np.concatenate([keys, keys + np.uint64(1), rnd.integers(0, 1 << 63, 1000).astype(np.uint64), [np.uint64(0)]])
        want = {int(k): i for i, k in enumerate(keys)}
        assert places.find(asked).tolist() == [want.get(int(k), -1) for k in asked]
        # as many looks at slots as the longest run of taken ones allows
        taken = np.flatnonzero(np.diff(np.concatenate([[0], (places.slots >= 0), [0]])))
        assert len(keys) == 0 or (places.slots >= 0).mean() <= 0.5 and (taken[1::2] - taken[::2]).max() < 200


def test_model_against_dictionaries(spark, short_stretches):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("aab cé.\n") for _ in range(rnd.randrange(90))) for _ in range(40)]
    rows = [("x", t) for t in texts] + [("y", "zz top"), ("y", "")]
    path = Q.write_model(Q.model(spark.createDataFrame(rows, "lang string, text string").repartition(3)))
    p, rests = slow_model(texts)
    arrays = Q.load_model(path)["x"]
    for t in texts[:10] + ["never seen: QQ#", "a", "é" * 200]:
        assert sum(arrays.logs(s).sum() for s in Q.runs(t)) == pytest.approx(slow_log_p(t, p, rests))
    # every context's probabilities add up to one over all code points
    for context in [(Q.START,) * 3, tuple(map(ord, "aab")), tuple(map(ord, "QQ#"))]:
        after = np.array([arrays.logs(np.array([*context, ord(w)], dtype=np.uint32))[0] for w in "abcé .\nQ"])
        rest = 1 / Q.UNIFORM - 7            # the code points that no text has are alike
        assert (10 ** after[:-1]).sum() + rest * 10 ** after[-1] == pytest.approx(1)


def test_characters_are_told_apart(spark):
    """Characters alike in kind (capitals, digits, letters far apart in Unicode) are not one symbol."""
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("AB 12\u00e9\u4e00x") for _ in range(rnd.randrange(90))) for _ in range(40)]
    path = Q.write_model(Q.model(spark.createDataFrame([("x", t) for t in texts], "lang string, text string")))
    arrays = Q.load_model(path)["x"]
    rate = lambda t: sum(a.sum() for a in map(arrays.logs, Q.runs(t)))
    for known, other in (("AB", "CD"), ("12", "34"), ("\u00e9", "\u00fd"), ("\u4e00", "\u4e14"), (" x", "\tx")):
        assert rate(known * 3) > rate(other * 3) + 1


def test_more_characters_than_sixteen_bits(spark, short_stretches):
    texts = ["".join(map(chr, range(k, k + 40_000))) for k in (0x10000, 0x20000, 0x100000)]
    counts = Q.Counts()
    for t in texts:
        for symbols in Q.runs(t):
            counts.add(symbols)
    counts.settle()
    context, char, n = counts.grams
    want = Counter()
    for t in texts:
        points = (Q.START,) * 3 + tuple(map(ord, t))
        want.update(zip(points, points[1:], points[2:], points[3:]))
    got = {(int(c) >> 42, int(c) >> 21 & 0x1FFFFF, int(c) & 0x1FFFFF, int(w)): int(m) for c, w, m in zip(context, char, n)}
    assert got == want


def test_quality_of_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = {r["doc_id"]: r for r in Q.judge(docs, labels).collect()}
    texts = dict(docs.select("doc_id", "text").collect())
    assert len(rows) == len(texts)
    for i, r in rows.items():
        base = slow_base(texts[i])
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        inside = r["perplexity"] is None or r["least_perplexity"] is None or (
            r["least_perplexity"] <= r["perplexity"] <= r["most_perplexity"])
        assert tuple(r[1:7]) == (*base, failed) and r["kept"] == (not failed and inside)


def test_bands_hold_on_documents_without_labels(spark):
    """Fit on three quarters of the labels, judged on the others."""
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = Q.judge(docs, labels.filter("doc_id % 4 <> 1")).filter("doc_id % 4 = 1 AND NOT base_failed").join(labels, "doc_id")
    kept = Counter((r["quality"], r["kept"]) for r in rows.collect())
    assert kept[1, True] > 0.99 * (kept[1, True] + kept[1, False])
    assert kept[0, False] > 0.9 * (kept[0, True] + kept[0, False])


def test_quality_cases(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1), (5, 0), (4, 1), (None, 1), (9, 0), (20, None)], "doc_id long, quality int")
    for marks in (labels, labels.limit(0)):
        got = Counter((r["doc_id"], *r[1:7], r["kept"]) for r in Q.judge(odd, marks).collect())
        want = Counter()
        for i, t in odd_pairs():
            base = slow_base(t)
            failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
            want[i, *base, failed, not failed] += 1      # no language, so no band
        assert got == want
    named = odd.fillna("en", ["lang"])
    assert Q.judge(named, labels).count() == odd.count()
    assert Q.judge(empty, labels).count() == 0


# ---- 12 conversation repair

def slow_repair(rows):
    """Cheapest edits of (role, fault) rows by trying all of them, audits compared as text."""
    best = {"": (0, "")}
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    def put(to, key, value):
        if key not in to or value < to[key]:
            to[key] = value

    def insert(nodes):
        out, new = dict(nodes), dict(nodes)
        for _ in range(2):
            step = {}
            for q, (c, a) in new.items():
                for z in follows[q].replace("s", ""):
                    put(step, z, (c + 2, a + "I"))
            for q, v in step.items():
                put(out, q, v)
            new = step
        return out

    for role, fault in rows:
        after = {}
        for q, (c, a) in insert(best).items():
            put(after, q, (c + 3, a + "D"))
            if fault not in (C.BLANK, C.DUPLICATE):
                more = int(fault == C.TRUNCATED)
                if role[:1] and role[:1] in follows[q]:
                    put(after, role[0], (c + more, a + "K"))
                for z in follows[q].replace("s", ""):
                    put(after, z, (c + more + 2, a + "R"))
        best = after
    return min(v for q, v in insert(best).items() if q in ("", "a"))


def slow_conversation(conv_id, rows):
    """(turn, role, text) rows in their order, already damaged."""
    seen, marked, n = set(), [], Counter()
    for turn, role, text in rows:
        bare = text.rstrip(C.SPACES)
        fault = (C.BLANK if not bare else C.DUPLICATE if (role, text) in seen
                 else C.OK if bare[-1] in ".!?" else C.TRUNCATED)
        seen.add((role, text))
        n[fault] += 1
        marked.append((role, fault))
    cost, audit = slow_repair(marked)
    out, todo = [], list(rows)
    kept = [x for x in audit if x != "D"]
    for x in audit:
        row = None if x == "I" else todo.pop(0)
        if x != "D":
            left = len(kept) - len(out)
            role = row[1] if x == "K" else "assistant" if left % 2 else "user"
            out.append(f"{role}:{'' if x == 'I' else row[2]}")
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (conv_id, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n[C.BLANK], n[C.DUPLICATE],
            n[C.TRUNCATED], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def slow_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv]
        if kind:
            row = (turn, "user" if kind == 4 else role,
                   "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out[conv] += [row] * (2 if kind == 3 else 1)
    for conv, kept in out.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, fault string, again int"


def random_rows(seed, conversations, most):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "and then", "Why? ", "", " \t", "...", "Été.\n", None, "é", "ok.\x0b"]
    roles = ["system", "user", "assistant", "user", "assistant", "user", "assistant", "tool", "", None, "USER", "s"]
    rows = []
    for conv in range(conversations):
        for turn in range(rnd.randrange(most)):
            rows.append((conv, rnd.choice([turn, turn, turn, turn - 1, None, turn + 3]), rnd.choice(roles), rnd.choice(texts)
                         if rnd.random() < 0.5 else f"Text number {turn}."))
    rows += [(None, 1, "user", "Hello."), (None, None, "assistant", "Hi."), (-5, None, None, None)] + [(777, 1, "user", "Twice.")] * 3
    return rows


@pytest.mark.parametrize("block", [1, 3, 32])
def test_repair_against_all_edits(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    C.block_table.cache_clear()
    rows = random_rows(block, 120, 14)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS).repartition(3)
    damaged = C.damaged(df)
    if block != 32:         # workers use the module's block: run the stream here instead
        sorted_ = C.in_order(C.faults(damaged)).toArrow().to_batches(max_chunksize=7)
        got = [tuple(r.values()) for b in C.results(sorted_) for r in b.to_pylist()]
    else:
        got = list(map(tuple, C.repair(damaged).collect()))
    want = [slow_conversation(conv, kept) for conv, kept in slow_damage(rows).items()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_paths_that_meet_late(monkeypatch):
    """Long conversations whose first edits hang on the last rows, in many blocks."""
    rnd = random.Random(8)
    for n in (70, 200):
        for symbols in ("u", "ua", "a", "uua", "x", "sua"):
            now, rows = C.Conversation(1), []
            for k in range(n):
                role = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}[symbols[k % len(symbols)]]
                fault = rnd.choice([C.OK, C.OK, C.TRUNCATED]) if n > 70 else C.OK
                now.add(k, role, f"t{k}", fault)
                rows.append((role, fault))
            cost, audit = slow_repair(rows)
            assert now.result()[6:8] == (cost, audit)


def test_repaired_messages(spark):
    rows = random_rows(4, 60, 12)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS).repartition(3)
    damaged = C.damaged(df)
    found = C.repair(damaged)
    out = defaultdict(list)
    for r in C.repaired(damaged, found).collect():
        out[r["conv_id"]].append((r["position"], f"{r['role']}:{r['text']}", r["edit"]))
    for r in found.collect():
        lines = sorted(out[r["conv_id"]])
        assert [k for k, _, _ in lines] == list(range(len(lines)))
        assert hashlib.sha256("\n".join(x for _, x, _ in lines).encode()).hexdigest() == r["repaired_sha256"]
        assert "".join(e for _, _, e in lines) == r["audit"].replace("D", "")


def test_no_conversations(spark):
    df = spark.createDataFrame([], CONVERSATIONS)
    assert C.repair(C.damaged(df)).count() == 0 and C.repaired(C.messages(df), C.repair(C.messages(df))).count() == 0


# ---- 13 spelling variants

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def slow_variants(pairs, least_chars=5, least_n=3):
    n = Counter()
    for i, t in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_chars and k >= least_n}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def test_variants_against_all_pairs(spark, odd, empty):
    rnd = random.Random(1)
    base = ["color", "colour", "colours", "naïveté", "Ärger", "letter", "tetler", "stressed", "desserts", "aaaaa", "aaaaaa", "ababab"]
    text = []
    for w in base:
        text += [w] * rnd.randrange(1, 40)
        for _ in range(12):
            k = rnd.randrange(len(w))
            v = rnd.choice([w[:k] + w[k + 1:], w[:k] + rnd.choice("aeéÿxÀ") + w[k:], w[:k] + rnd.choice("bß×oü") + w[k + 1:]])
            text += [v] * rnd.randrange(1, 9)
    rnd.shuffle(text)
    pairs = [(k, rnd.choice([" ", "\n", "-", "1", "ŁÆ "]).join(text[k * 9:k * 9 + 9])) for k in range(len(text) // 9)]
    pairs += [(3, "color " * 5), (None, "color Color COLOR"), (4, None), (5, ""), (6, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 3000)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    assert set(map(tuple, S.variants(df).collect())) == slow_variants(pairs)
    assert set(map(tuple, S.variants(odd).collect())) == slow_variants(odd_pairs())
    assert S.variants(empty).count() == 0


def test_signatures_meet_for_every_edit():
    rnd = random.Random(3)
    many, few = S.Dimensions(S.REPLACE), S.Dimensions(S.INSERT)
    for _ in range(2000):
        w = "".join(rnd.choice("aabcéß") for _ in range(rnd.randrange(1, 12)))
        k = rnd.randrange(len(w))
        other = w[:k] + rnd.choice("abcdé") + w[k + 1:]
        longer = w[:k] + rnd.choice("abcdé") + w[k:]
        assert set(S.signatures([w], 0, many)[0]) & set(S.signatures([other], 0, many)[0])
        assert set(S.signatures([w], 1, few)[0]) & set(S.signatures([longer], 2, few)[0])


def test_stretches_keep_words_whole(short_stretches):
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdeé  -") for _ in range(5000)) + "q" * 300 + " end"
    assert [w for part in S.stretches(text) for w in S.RUN.findall(part)] == S.RUN.findall(text)
    assert "".join(S.stretches(text)) == text == "".join(Q.stretches(text))
