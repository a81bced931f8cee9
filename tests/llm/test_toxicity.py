"""Toxicity: slopes against differences, scores against a plain noisy-or, held-out labels, planted sentences, and edge cases."""

import math
import random
import re
import zlib

import numpy as np

from emberlattice.llm.toxicity import Instances, Remembered, learned, locate, score_documents, slope

SCHEMA = "doc_id long, text string, y int, score int, sentence int"


def plain(model, text):
    """Scores of the sentences that have words, from the definition."""
    out = []
    for part in re.split(r"[.!?\n]", (text or "").lower()):
        words = re.findall(r"[^\x00-\x60\x7B-\x7F]+", part)
        if words:
            z = model.bias
            for w in words:
                z += model.weights.get(w, 0) + sum(model.weights.get(w[:k] + "~", 0) for k in range(4, 9) if len(w) > k)
            out.append(1 / (1 + math.exp(-z)))
    return out


def corpus(n=400, seed=7):
    rng = random.Random(seed)
    calm = ["".join(rng.choices("aeioulnrst", k=rng.randrange(2, 8))) for _ in range(150)] + ["Été", "日本"]
    rude = ["moronic", "Schwachkopf", "scum"]
    rows, labels = [], {}
    for i in range(n):
        said = [" ".join(rng.choices(calm, k=rng.randrange(3, 9))) for _ in range(rng.randrange(1, 9))]
        labels[i] = int(rng.random() < 0.3)
        if labels[i]:
            at = rng.randrange(len(said))
            said[at] += " " + rng.choice(rude) + rng.choice(["", "er", "est"])
        rows.append((i, "".join(s + rng.choice([". ", "!", "\n", "? "]) for s in said)))
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 9, 9, 9) for r in rows], SCHEMA).repartition(3)
    return docs, spark.createDataFrame([(i, y, None) for i, y in labels], "doc_id long, toxic int, quality int")


def test_slope_equals_differences():
    rng = np.random.default_rng(1)
    n, y = np.array([3, 0, 2, 4]), np.array([1, 1, 0, 1])
    sentence, feature = rng.integers(0, 9, 30), rng.integers(0, 5, 30)
    w, b = rng.normal(size=5), -1.5
    _, by_weight, by_bias = slope(y, n, sentence, feature, w, b)
    loss = lambda w, b: slope(y, n, sentence, feature, w, b)[0]
    for k in range(5):
        d = np.eye(5)[k] * 1e-6
        assert abs((loss(w + d, b) - loss(w - d, b)) / 2e-6 - by_weight[k]) < 1e-5
    assert abs((loss(w, b + 1e-6) - loss(w, b - 1e-6)) / 2e-6 - by_bias) < 1e-5


def test_learns_from_documents_and_finds_the_sentences(spark):
    rows, labels = corpus()
    docs, truth = frames(spark, rows + [(None, rows[0][1]), (1000, None), (1001, ""), (1002, " .. !\n"), (1003, "la " * 40_000 + ". You scum!"), rows[5], rows[5]], [*labels.items(), (None, 1), (3, None)])
    model = learned(docs, truth, rounds=25)
    got = score_documents(docs, model).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + 7 and sum(r.doc_id == 5 for r in got) == 3
    texts = dict(rows)
    for i, r in by_id.items():
        if i in texts:
            own = plain(model, texts[i])
            assert abs(r.score - (1 - math.prod(1 - p for p in own))) < 1e-9 and r.n_sentences == len(own) and abs(own[r.worst_sentence] - max(own)) < 1e-12
            assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)
    assert not by_id[None].held_out and all(by_id[i].score == 0 and by_id[i].n_sentences == 0 for i in (1000, 1001, 1002)) and by_id[1003].predicted == 1
    kept = [i for i in labels if by_id[i].held_out]
    assert sum(by_id[i].predicted == labels[i] for i in kept) >= 0.95 * len(kept) > 60
    found = locate(docs, model, 0.5).collect()
    rude = re.compile("moronic|schwachkopf|scum", re.I)
    held = [r for r in found if r.doc_id in texts]
    for r in held:
        assert texts[r.doc_id][r.begin : r.end] == r.text and abs(plain(model, r.text)[0] - r.score) < 1e-12
    assert sum(bool(rude.search(r.text)) for r in held) >= 0.95 * len(held) and len({r.doc_id for r in held}) >= 0.9 * sum(labels.values())


def test_one_label_and_empty_tables(spark):
    docs, truth = frames(spark, [(1, "so. it is"), (3, None)], [(1, 0), (3, 0)])
    got = {r.doc_id: r.score for r in score_documents(docs, learned(docs, truth)).collect()}
    assert 0 < got[1] < 0.5 and got[3] == 0
    none, nothing = docs.limit(0), truth.limit(0)
    assert score_documents(none, learned(none, nothing)).count() == 0 and locate(none, learned(none, nothing)).count() == 0


def test_words_are_remembered_within_bounds():
    known = Remembered(Instances({"abcd~": 1.0, "abcdef": 2.0}).word)
    assert known[b"abcdef"] == 3.0 and known[b"abcd"] == 0.0 and len(known) == 2
