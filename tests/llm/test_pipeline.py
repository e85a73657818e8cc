"""The pipeline against a plain version, and its stages on odd inputs."""

import re
from collections import Counter

import corpus_pipeline as P
from llm.conftest import odd_pairs
from llm.test_operators import brute_groups, brute_matches, slow_best_fit
from mise.llm import toxicity
from mise.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_version(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    clean = P.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {i for i, s in scores.items() if s < 0.3}

    cut = P.drop_lines(spark, clean, SF)
    assert cut.dtypes == docs.dtypes
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    found = Counter(k for t in before.values() for k in set(map(key, t.split("\n"))))
    for r in cut.collect():
        kept = "\n".join(x for x in before[r["doc_id"]].split("\n") if not (key(x) and found[key(x)] >= 10))
        assert r["text"] == kept and r["n_chars"] == len(kept)

    one = P.drop_copies(spark, cut, SF)
    pairs = sorted((r["doc_id"], r["text"]) for r in cut.collect())
    sets, group = brute_groups(pairs, 5)
    first = {g: i for (i, _), g in reversed(list(zip(pairs, group)))}
    assert {r["doc_id"] for r in one.collect()} == {i for (i, _), g, s in zip(pairs, group, sets) if not s or first[g] == i}

    packed = P.pack(spark, one, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in one.collect()}
    assert len({r["sequence_id"] for r in packed}) == len(slow_best_fit([r["length"] for r in packed], 4096))
    digest = lambda rows: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert digest(P.run(spark, SF).collect()) == digest(packed)


def test_stages_on_odd_rows(spark, odd, empty):
    for df in (odd, empty):
        for name, stage in P.STAGES:
            df_out = stage(spark, df, SF)
            if name != "packing":
                assert df_out.dtypes == df.dtypes, name
            df_out.collect()
    cut = {(r["doc_id"], r["text"]) for r in P.drop_lines(spark, odd, SF).collect()}
    assert (None, None) in cut and (1, None) in cut and (2, "") in cut
    assert not any("COMMON LINE" in (t or "") for _, t in cut) and len(odd_pairs()) == odd.count()
    assert brute_matches(None, toxicity.Model({}, [], None)) == 0
