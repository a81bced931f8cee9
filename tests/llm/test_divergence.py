"""The audit against brute force with whole numbers: nulls, sources without terms, languages that keep none, several shards and blocks of sources, huge counts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from emberlattice.llm import divergence as module
from emberlattice.llm.divergence import audit, run_divergences, runs_of, shares_of, terms

SCHEMA = "doc_id long, text string, lang string, source string, n int, term string, total int, at int"


def brute(rows, most=200):
    docs, count, by_lang, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        sources[lang].add(source)
        docs[lang].update(set(found))
        count[lang, source].update(found)
        by_lang[lang].update(found)
    out = []
    for lang, some in sources.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        total = {s: sum(count[lang, s][t] for t in kept) + len(kept) for s in some}
        p = {s: [1 + 10**9 * (count[lang, s][t] + 1) // total[s] for t in kept] for s in some}
        whole = sum(by_lang[lang][t] for t in kept) + len(kept)
        q = [1 + 10**9 * (by_lang[lang][t] + 1) // whole for t in kept]
        for s in some:
            pairs = [(o, sum((x - y) ** 2 // y for x, y in zip(p[s], p[o]))) for o in some if o != s]
            own = [(t, (x - y) ** 2 // y) for t, x, y in zip(kept, p[s], q) if count[lang, s][t] and x > y]
            for part, values, limit in (("pair", pairs, None), ("term", own, most)):
                ranked = sorted(values, key=lambda v: (-v[1], v[0].encode()))[:limit]
                out += [(lang, s, part, item, value, r) for r, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def corpus(seed, n, n_sources):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "é", "日本", "THE", "the", "Δ"]
    rows = [(i, rng.choice([" ", "\n", "7", "-"]).join(rng.choices(words, k=rng.randrange(0, 40))), rng.choice(["en", "en", "de"]), f"s{rng.randrange(n_sources)}") for i in range(n)]
    rows += [(None, None, None, None), (1, "", None, "x"), (2, "one two", "fr", "a"), (3, "3 4 5", "fr", "b"), (4, None, "en", "empty"), (5, "the " * 30_000, "en", "s1"), rows[3], rows[3]]
    return rows


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in audit(df, **more).collect())


def test_equals_brute_force(spark):
    rows = corpus(1, 150, 5)
    assert got(spark, rows) == brute(rows)


def test_several_shards_blocks_and_tallies(spark, monkeypatch):
    for name, small in (("SHARD_TERMS", 16), ("SOURCES", 3), ("TALLY", 50)):
        monkeypatch.setattr(module, name, small)
    rows = corpus(2, 120, 8)
    assert got(spark, rows, most=7) == brute(rows, most=7)


def test_no_documents_and_nothing_kept(spark):
    assert got(spark, []) == []
    rows = [(1, "a b", "en", "x"), (2, "c", "en", "y")]
    assert got(spark, rows) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_terms_are_runs_of_letters():
    assert terms("Über-THE x9y\x7f日本 z") == ["Über".encode(), b"the", b"x", b"y", "日本".encode(), b"z"] and terms(None) == terms("") == []


@pytest.mark.parametrize("top", [3, 10**6, 10**11])
def test_runs_give_the_sums_of_single_terms(top):
    rng = np.random.default_rng(0)
    a, b = (np.sort(rng.integers(0, 5, 60)) * top for _ in range(2))
    total = int(a.sum()) + 60
    p, q = shares_of(a, total), [1 + 10**9 * (int(x) + 1) // (total + 5) for x in b]
    there, back = run_divergences(runs_of(a, total), runs_of(b, total + 5), 60)
    assert there == sum((int(x) - y) ** 2 // y for x, y in zip(p, q)) and back == sum((int(x) - y) ** 2 // int(x) for x, y in zip(p, q))
