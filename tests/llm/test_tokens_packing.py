import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from emberlattice.llm.packing import pack_documents, pack_examples
from emberlattice.llm.token_counts import count_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", "a b", "a  b", " a", "a ", "\n", "a\nb", "a \n b", "\na", "a\n", "a\n\nb c", "▁x", "a▁b", "▁", "<s>a</s>", "<|endoftext|>",
    "a <|endoftext|> b<|endoftext|>", "é à ü", "a　b 　 c", "\x00a \x1c b", "a\t b", "don't we'll  1234 !!?", "x" * 5000, "ab " * 3000, "end.\r\n next",
    "日本語 テキスト", "a  b   c", "   \n  lots   of\n\n  space  ",
]


def texts():
    rng = random.Random(5)
    alphabet = ["a", "the", " ", " ", "\n", "é", "▁", "1", "'s", "!", "\t", "日", "Word", "  "]
    return ODD + ["".join(rng.choices(alphabet, k=rng.randrange(1, 60))) for _ in range(300)]


def test_token_counts_match_library(spark):
    rows = list(enumerate(texts())) + [(3, "again a"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_bytes long, n_tokens long")
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((str(i), len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 100) for i, t in rows)
    for frequent in (0, 50):
        got = sorted((str(r[0]), r[1], r[2], r[3]) for r in count_tokens(df, MODEL, limit=100, frequent=frequent).collect())
        assert got == want
    assert count_tokens(df.limit(0), MODEL).count() == 0


def test_packing_round_trip(spark):
    rows = list(enumerate(texts())) + [(9000, "dup dup"), (9001, "dup dup")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    got = pack_documents(df, BYTES).collect()
    tokenizer = Tokenizer.from_file(BYTES)
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(docs) == {i for i, _ in rows}
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in seqs.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
        total = sum(r.length for r in pieces)
        assert total <= 1024 and total & (total - 1) == 0
    assert pack_documents(df.limit(0), BYTES).count() == 0


def test_packing_examples_keeps_limits(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(0, 300), 0) for i in range(4000)]
    rows = [(i, t, rng.randrange(0, t + 1)) for i, t, _ in rows] + [(5000, 9999, 1), (5001, None, 1), (5002, 10, None)]
    df = spark.createDataFrame(rows, "k long, t long, l long").repartition(2)
    got = pack_examples(df, "k", "t", "l", max_tokens=512, max_segments=6, max_loss=300).collect()
    assert sorted(r.k for r in got) == sorted(r[0] for r in rows)
    assert {r.k for r in got if not r.fits} == {5000, 5001, 5002}
    seqs = defaultdict(list)
    for r in got:
        if r.fits:
            seqs[r.sequence_id].append(r)
    for s in seqs.values():
        assert sum(r.tokens for r in s) <= 512 and sum(r.loss_tokens for r in s) <= 300 and len(s) <= 6
    used = sum(r.tokens for r in got if r.fits) / (512 * len(seqs))
    assert used > 0.9 or sum(r.loss_tokens for r in got if r.fits) / (300 * len(seqs)) > 0.9
