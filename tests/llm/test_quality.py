"""Scores of the classifier against a plain discriminant, written anew from the raw texts."""

import random
import re
import zlib
from collections import Counter
from math import log, log1p, sqrt

import numpy as np

from emberlattice.llm.quality import classify


def numbers(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    if not words:
        return [0.0] * 16
    n, letters, counts = len(words), sum(map(len, words)), Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda some: sum(b in some for b in raw) / letters
    return [
        log1p(len(raw)), log1p(n), log1p(letters / n), sqrt(len(counts) / n) * log1p(n) / 8, sqrt(max(counts.values()) / n),
        sqrt(sum(a == b for a, b in zip(words, words[1:])) / n), sqrt(share(range(65, 91))), sqrt(share(b"#$%&*+/<=>@\\^_`{}~[]")), sqrt(share(range(48, 58))),
        sqrt(share(b".,;:?")), sqrt(raw.count(b"|") / n), sqrt(raw.count(b"!") / n), log1p(n / len(lines)), sqrt(1 - len(set(lines)) / len(lines)),
        sqrt(share(range(128, 256))), sqrt(sum(len(w) > 24 for w in counts) / len(counts)),
    ]


def plain_scores(texts, taught):
    x = np.array([numbers(t) for t in texts])
    known, y = x[[i for i, _ in taught]], np.array([v for _, v in taught])
    mean, sd = known.mean(0), np.sqrt(np.maximum(known.var(0), 1e-12))
    z, known = (x - mean) / sd, (known - mean) / sd
    cov = [np.cov(known[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum((y == c).mean() * cov[c] for c in (0, 1))
    logs = []
    for c in (0, 1):
        s = 0.9 * cov[c] + 0.1 * pooled
        s = 0.9 * s + 0.1 * max(np.trace(s) / 16, 1e-6) * np.eye(16)
        away = z - known[y == c].mean(0)
        logs.append(log((y == c).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (away * np.linalg.solve(s, away.T).T).sum(1))
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def test_scores_equal_a_plain_discriminant(spark):
    rng = random.Random(4)
    good, bad = [f"word{i}" for i in range(400)] + ["Ärger", "日本", "fin."], ["BUY", "|", "$$$", "now!!", "x" * 30, "99"]
    texts = [None, "", " \n", "日本", "日本 ", "word " * 60_000]
    labels = {}
    for _ in range(240):
        y = rng.randrange(2)
        parts = [rng.choice(good if rng.random() < (0.95 if y else 0.4) else bad) for _ in range(rng.randrange(3, 90))]
        labels[len(texts)] = y
        texts.append("".join(w + rng.choice([" ", " ", "\n"]) for w in parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    truth = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    taught = [(i, y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5]
    got = {r.doc_id: r for r in classify(docs, truth).collect()}
    for i, want in enumerate(plain_scores(texts, taught)):
        assert abs(got[i].score - want) < 1e-7 and got[i].predicted == int(want >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
