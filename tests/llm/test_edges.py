"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import hashlib
import random
import re

import numpy as np

from emberlattice.scratch import written
from emberlattice.operators.graph import connected
from emberlattice.llm.decontaminate import decontaminate, item_pieces
from emberlattice.llm.license_texts import TEXTS
from emberlattice.llm.licenses import scan_licenses
from emberlattice.llm.metric_tree import top_k
from emberlattice.llm.ngram_join import jaccard_components
from emberlattice.llm.substrings import kept, remove_repeats
from emberlattice.llm.suffixes import remove_repeated_bytes

SCHEMA = "doc_id long, text string, n int, key int, rep int, bucket int, text_key int"


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "日本", "The", "THE", "the"]
    base = [rng.choices(vocabulary, k=rng.randrange(20, 120)) for _ in range(12)]
    texts = [None, "", "  \n ", "one two", "One  TWO", "x" * 300, "y" * 40 + "x" * 200, "a " * 400, "a " * 60, "word " * 13]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(rng.randrange(0, 6)):
            c = list(b)
            for _ in range(rng.randrange(0, 4)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", "  "]).join(c))
        texts.append(" ".join(rng.choices(vocabulary, k=15) + b[3:18] + rng.choices(vocabulary, k=9)))
    rng.shuffle(texts)
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts)]
    return rows + [(rows[5][0], rows[5][1]), (None, texts[3]), (None, " ".join(base[0]))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, 0, 0, 0, 0) for i, t in rows], SCHEMA).repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def covered(items, size):
    """For each row: which entries lie in a run of `size` that also starts in a row with a smaller id."""
    first = {}
    for i, x in items:
        if i is not None:
            for k in range(len(x) - size + 1):
                r = tuple(x[k : k + size])
                first[r] = min(first.get(r, i), i)
    out = []
    for i, x in items:
        gone = set()
        for k in range(len(x) - size + 1):
            if i is not None and first[tuple(x[k : k + size])] < i:
                gone |= set(range(k, k + size))
        out.append(gone)
    return out


def test_substrings_and_suffixes(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = frame(spark, rows)
        items = [(i, words(t)) for i, t in rows]
        want = sorted((str(i), len(w), len(g), sha(" ".join(x for k, x in enumerate(w) if k not in g).encode())) for (i, w), g in zip(items, covered(items, 13), strict=True))
        got = remove_repeats(df, with_text=True, shard_words=100, scan_bytes=3000, bucket_bytes=2000).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
        assert all(sha(" ".join(words(r.kept_text)).encode()) == r.kept_sha256 for r in got if r.kept_text is not None)
        items = [(i, (t or "").encode()) for i, t in rows]
        want = []
        for (i, b), g in zip(items, covered(items, 50), strict=True):
            want.append((str(i), len(b), len(g), sum(k - 1 not in g for k in g), sha(bytes(x for k, x in enumerate(b) if k not in g))))
        got = remove_repeated_bytes(df, block_bytes=500).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    empty = frame(spark, rows).limit(0)
    assert remove_repeats(empty).count() == 0 and remove_repeated_bytes(empty).count() == 0
    assert kept(" a b\nc  d e ", [(1, 3)]) == " a d e" and kept("a b", [(0, 2)]) == ""


def test_strings_of_a_block_are_grouped_in_one_order(monkeypatch):
    """Equal strings stand together by rising document, are told apart where hashes clash, and a partition's answers find their places in any order."""
    from emberlattice.llm import suffixes

    texts = [b"abcdefghijklmnopqrstuvwxyz" * 3, b"the quick brown fox jumps over the lazy dog " * 2, b"abcdefghijklmnopqrstuvwxyz" * 3]
    row = {"block": 0, "docs": np.array([1, 4, 9]).tobytes(), "sizes": np.array([len(t) for t in texts]).tobytes(), "text": b"".join(texts)}
    whole = row["text"]
    assert suffixes.words_of(whole).tolist() == [int.from_bytes(whole[i : i + 8]) for i in range(len(whole) - 7)] and not len(suffixes.words_of(b"short"))
    for clash in (False, True):
        if clash:
            monkeypatch.setattr(suffixes, "runs_of_bytes", lambda data, width: np.zeros(len(data) - width + 1, np.uint64))
        b = suffixes.Block(row)
        at, starts = b.alike(suffixes.SIZE)
        assert sorted(at.tolist()) == [i for i in range(len(whole)) if b.left[i] >= 50]
        runs = [[whole[i : i + 50] for i in r] for r in np.split(at, starts[1:])]
        assert all(len(set(r)) == 1 for r in runs) and (clash or len(runs) == len({r[0] for r in runs}))
        assert all((np.diff(b.docs[b.chunk[r]]) >= 0).all() for r in np.split(at, starts[1:]))
        cut = np.array([int.from_bytes(b"fghijklm"), int.from_bytes(b"q       ")], np.uint64)
        sent = suffixes.Sent(b, cut)
        strings = [whole[i : i + 17] for i in sent.at[sent.starts]]
        order = [sorted({x for x, q in zip(strings, sent.parts, strict=True) if q == p}) for p in range(3)]
        found = [{"part": p, "name": np.array([order[p].index(x) for x, q in zip(strings, sent.parts, strict=True) if q == p], np.uint32).tobytes()} for p in (2, 0, 1)]
        names = suffixes.Names({p: len(x) for p, x in enumerate(order)}, 3).settled(found, sent, len(whole))
        every = sum(order, [])
        assert every == sorted(set(strings)) and all(every[names[i]] == whole[i : i + 17] for i in sent.at)


def test_jaccard(spark):
    rows = corpus(3)
    got = jaccard_components(frame(spark, rows), chunk=2, blocks=3).collect()
    sets = {}
    for i, t in rows:
        w = words(low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(i), str(None if i is None else find(i))) for i, _ in rows)
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {i: len(s) for i, s in sets.items() if i is not None}
    assert jaccard_components(frame(spark, rows).limit(0)).count() == 0


def test_jaccard_joins_loose_families(spark):
    """A chain whose ends are far apart, and two stars whose leaders aren't linked but members are."""
    base = [f"t{i}" for i in range(300)]
    rows = []
    for k in range(40):
        rows.append((k, " ".join([f"u{k}_{i}" for i in range(6 * k, 0)] + [f"c{j}" for j in range(4 * k, 4 * k + 200)])))
    rng = random.Random(7)
    for k in range(60):
        c = list(base)
        for p in rng.sample(range(300), rng.randrange(1, 12)):
            c[p] = f"z{k}_{p}"
        rows.append((100 + k, " ".join(c)))
    got = {r.doc_id: r.component_id for r in jaccard_components(frame(spark, rows), chunk=4).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert got == {i: find(i) for i in sets}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pieces_of_items(spark):
    bench = spark.createDataFrame([("a", "w " * 50)] * 20 + [("b", "One, two!"), ("c", None), (None, "É é 日本"), ("d", "!")], "item string, text string")
    got = item_pieces(bench, 10, 7).distinct().collect()
    assert sorted((r.item or "", r.text) for r in got) == sorted([("a", "w " * 15 + "w"), ("a", "w " * 14 + "w"), ("b", "one two"), ("", "É é 日本")])


def test_decontamination(spark):
    rows = corpus(4)
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    items = [(1, " ".join(words(rows[20][1])[2:14])), (2, "one, TWO!"), (3, None), (None, rows[25][1]), (4, "..."), (5, rows[30][1]), (5, rows[30][1]), (6, "the"), (10, "w1 w2")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    windows = [(i, tuple(w[k : k + 10])) for i, t in items if (w := cut(t)) for k in range(max(1, len(w) - 9))]
    want = []
    for i, t in rows:
        w, hit, found = cut(t), set(), set()
        for item, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(item)
        names = sorted(str(x) for x in found if x is not None)
        want.append((str(i), len(w), len(hit), len(names), sha(",".join(names).encode()), bool(hit)))
    for block, piece in ((1 << 20, 20_000), (100, 20_000), (200, 3)):
        got = decontaminate(frame(spark, rows), bench, block_bytes=block, piece_windows=piece).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(want)
    assert decontaminate(frame(spark, rows), bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate(frame(spark, rows).limit(0), bench).count() == 0


def test_top_k(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(230)]
    rows += [(300 + i, rows[3][1]) for i in range(40)] + [(500, None), (520, [1.0, None] * 4), (540, [float("nan")] * 8), (560, [float("inf")] * 8), (None, [0.1] * 8), (580, [0.5] * 5), (600, [])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, score int, block int").repartition(3)
    got = top_k(df, "vec_id % 20 = 0", k=7, page=16, subtree_pages=2, block=5, pivots=9, stored=lambda d: written(d, "t")).collect()
    import math

    import numpy as np

    good = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in good:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(good[q], good[c])), c) for c in good if c != q)[:7]
            want += [(q, n, c, -s) for n, (s, c) in enumerate(scores, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert top_k(df.limit(0), "vec_id % 20 = 0").count() == 0
    assert top_k(df.filter("vec_id = 20"), "vec_id % 20 = 0").count() == 0


def test_licenses(spark):
    rows = [(1, "Copyright (c) 2020 Someone\nReleased under the  MIT LICENCE!\n"), (2, None), (3, ""), (None, "x\nLicensed under CC BY-NC 4.0.\nReleased under the MIT license"), (4, "Released under the MIT License. More."), (4, "Released under the MIT License. More.")]
    got = {(r.doc_id, r.license_id, r.n_license_lines, r.line_licenses) for r in scan_licenses(frame(spark, rows)).collect()}
    assert got == {(1, "MIT", 1, "MIT"), (2, None, 0, ""), (3, None, 0, ""), (None, None, 2, "CC-BY-NC-4.0,MIT"), (4, None, 0, "")}
    assert scan_licenses(frame(spark, rows)).count() == 6 and scan_licenses(frame(spark, rows).limit(0)).count() == 0


def test_one_id_on_two_texts(spark, tmp_path):
    import corpus_pipeline

    a, b, c = (" ".join(f"{p}{i}" for i in range(30)) for p in "abc")
    df = frame(spark, [(1, a), (2, a), (2, b), (3, c)])
    assert sorted((r.doc_id, r.n_removed) for r in remove_repeats(df, bucket_bytes=50).collect()) == [(1, 0), (2, 0), (2, 30), (3, 0)]
    assert sorted((r.doc_id, r.n_removed) for r in remove_repeated_bytes(df).collect()) == sorted([(1, 0), (2, 0), (2, len(a)), (3, 0)])
    spark.createDataFrame([("i", a)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = corpus_pipeline.benchmark_passages(spark, frame(spark, [(None, a), (None, b), (1, a), (1, c), (1, None)]), str(tmp_path)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == sorted([("None", b), ("1", c), ("1", "None")])
    left = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert {(1, a), (3, c), (2, b)} <= left


def test_jaccard_compares_every_text_of_an_id(spark):
    """Id 5 has two texts: one near a text of 1, one near a text of 9; the id links both."""
    a, b = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(100)]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (1, " ".join(a[:99])), (9, " ".join(b[:99])), (7, "other words stand here now"), (None, " ".join(a)), (5, None)]
    got = jaccard_components(frame(spark, rows), chunk=4).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted([("5", "1")] * 3 + [("1", "1"), ("9", "1"), ("7", "7"), ("None", "None")])


def test_whole_licence_texts_in_other_wrappings(spark):
    """Each known text is found below its title and a copyright line, wrapped at any width, and a changed one isn't."""
    import textwrap

    rows, want = [], {}
    for name, titles, text in TEXTS:
        for title in titles:
            for width in (30, 46, 80, 10_000):
                body = "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))
                rows.append((len(rows), f"{title}\nCopyright (c) 2021, A. Holder. All rights reserved.\n\n{body}"))
                want[rows[-1][0]] = name
        rows.append((len(rows), text.replace("software", "hardware", 1).replace("modification", "change", 1).replace("SOFTWARE", "HARDWARE", 1)))
        want[rows[-1][0]] = None
    rows.append((len(rows), "word " * 400_000 + "\nCopyright 2020"))
    want[rows[-1][0]] = None
    assert {r.doc_id: r.license_id for r in scan_licenses(frame(spark, rows)).collect()} == want
