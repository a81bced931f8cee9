"""Columns of repeated places, taken as arrays (F1: a Python object for each of them cost an eighth of op9's time)."""

import numpy as np
import pyarrow as pa

from emberlattice.llm import suffixes as S

FOUND = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int32()), ("whole", pa.bool_()), ("runs", pa.binary())]))


def runs(*pairs):
    return np.array(pairs, np.int64).tobytes()


def test_places_of_a_column():
    rows = [
        [{"start": 9, "n": 9, "whole": True, "runs": runs((1, 2))}],
        None,
        [{"start": 10, "n": 5, "whole": True, "runs": runs((1, 2))}, {"start": 20, "n": 8, "whole": False, "runs": runs((0, 3), (6, 8))}, {"start": 40, "n": 1, "whole": True, "runs": None}],
        [],
        [{"start": 7, "n": 4, "whole": False, "runs": runs((1, 4))}],
    ]
    got = sorted(zip(*(x.tolist() for x in S.runs_in(pa.array(rows, FOUND).slice(1))), strict=True))
    assert got == [(1, 10, 15), (1, 20, 23), (1, 26, 28), (1, 40, 41), (3, 8, 11)]
    assert [len(x) for x in S.runs_in(pa.array([None, []], FOUND))] == [0, 0, 0] == [len(x) for x in S.runs_in(pa.array([], FOUND))]


def test_removed_bytes_are_joined_within_a_row():
    begins, ends, row = (np.array(x) for x in ([12, 0, 5, 3, 10, 20], [15, 4, 10, 5, 12, 30], [1, 0, 0, 0, 1, 1]))
    assert [x.tolist() for x in S.removed(begins, ends, row)] == [[0, 10, 20], [10, 15, 30], [0, 1, 1]]
    none = np.zeros(0, np.int64)
    assert [len(x) for x in S.removed(none, none, none)] == [0, 0, 0]


def test_strings_end_to_end():
    data, at = S.end_to_end(pa.array([b"zz", b"ab", None, b"", b"cde"]).slice(1))
    assert [bytes(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)] == [b"ab", b"", b"", b"cde"]
    for nothing in (pa.array([], pa.binary()), pa.array([None, b""], pa.binary())):
        data, at = S.end_to_end(nothing)
        assert len(at) == len(nothing) + 1 and not at.any() and not len(data)


def test_hashes_by_slices_are_those_of_the_whole(monkeypatch):
    data = np.random.default_rng(5).integers(0, 4, 3000).astype(np.uint8)
    want = {w: S.runs_of_bytes(data, w) for w in (17, 26, 50)} | {-w: S.least_anchors(data, w) for w in S.SEEDS}
    plain = [int(S.runs_of_bytes(data[i : i + 17], 17)[0]) for i in range(len(data) - 16)]
    assert want[17].tolist() == plain and len(S.runs_of_bytes(data[:16], 17)) == 0 == len(S.least_anchors(data[:49], 26))
    for i in range(0, len(data) - 49, 97):
        assert want[-26][i] == S.runs_of_bytes(data[i : i + 50], 26).min()
    monkeypatch.setattr(S, "SLICE", 64)
    assert all((S.runs_of_bytes(data, w) == h if w > 0 else S.least_anchors(data, -w) == h).all() for w, h in want.items())


def test_keys_are_ordered_as_tuples():
    rng = np.random.default_rng(7)
    keys = [rng.integers(0, 1 << 63, 50).astype(np.uint64)[rng.integers(0, 50, 400)], rng.integers(0, 9, 400).astype(np.uint64) << np.uint64(58), rng.integers(0, 3, 400).astype(np.uint8)]
    order, new = S.ordered(keys)
    rows = [tuple(int(k[i]) for k in keys) for i in order]
    assert rows == sorted(rows) and int(new.sum()) == len(set(rows))
