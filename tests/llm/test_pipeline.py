import os
import re

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from emberlattice.llm.common import table
from emberlattice.scratch import written
from emberlattice.llm.quality import classify

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def near(docs):
    sets = {}
    for i, t in docs.items():
        w = words(low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in docs}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: t for i, t in docs.items() if find(i) == i}


def repeats(docs):
    first = {}
    for i in sorted(docs):
        w = words(docs[i])
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = {}
    for i, t in docs.items():
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def contaminated(docs, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    grams = set()
    for t in items:
        w = cut(t)
        if w:
            grams |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    sizes = {len(g) for g in grams}
    return {i for i, t in docs.items() if (w := cut(t)) and any(tuple(w[k : k + n]) in grams for n in sizes for k in range(len(w) - n + 1))}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    fetch = lambda df: {r.doc_id: r.text for r in df.collect()}
    everything = fetch(docs)
    good = written(corpus_pipeline.quality(spark, docs, SF), "q")
    scores = {r.doc_id: r.score for r in classify(docs, table(spark, SF, "labels")).collect()}
    kept = fetch(good)
    assert kept == {i: t for i, t in everything.items() if scores[i] >= 0.3}
    single = written(corpus_pipeline.near_duplicates(spark, good, SF), "n")
    kept = fetch(single)
    assert kept == near(fetch(good))
    shorter = written(corpus_pipeline.repeated_passages(spark, single, SF), "r")
    want = repeats(kept)
    got = fetch(shorter)
    assert {i: words(t) for i, t in got.items()} == want
    assert all(got[i] == kept[i] for i in kept if words(kept[i]) == want[i])
    assert all(r.n_chars == len(r.text) for r in shorter.collect() if r.text != kept[r.doc_id])
    clean = written(corpus_pipeline.benchmark_passages(spark, shorter, SF), "c")
    bad = contaminated(got, [r.text for r in table(spark, SF, "benchmark").collect()])
    assert bad and fetch(clean) == {i: t for i, t in got.items() if i not in bad}
    assert clean.columns == docs.columns
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.packed(spark, clean, SF).collect()
    assert sum(r.length for r in pieces) == sum(1 + len(tokenizer.encode(t, add_special_tokens=False).ids) for t in fetch(clean).values())
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in pieces) == sorted((r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r[0]: r[1] for r in duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall()}
    rows = classify(table(spark, sf, "documents"), table(spark, sf, "labels")).collect()
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(judged) > 500 and sum(a == b for a, b in judged) / len(judged) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 1), (None, "a b", 2), (3, "a b c", 0), (3, "a b c", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(3, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    rows = classify(docs, labels).collect()
    assert len(rows) == 5 and all(0 < r.score < 1 for r in rows)
    assert classify(docs.limit(0), labels.limit(0)).count() == 0
