import zlib

import numpy as np
import pytest

from bitext.llm import packing


def placed(histogram):
    """(sequence, offset, length) of all pieces by the plan's runs."""
    p = packing.plan(histogram)
    out = []
    for k, length in enumerate(p.length):
        last = k + 1 == len(p.length) or p.length[k + 1] != length
        end = histogram[length] if last else p.rank[k + 1]
        out += [(p.sequence[k] + r, p.offset[k], length) for r in range(end - p.rank[k])]
    return p, sorted(out)


def least(sizes, capacity):
    """Best-fit-decreasing, one at a time."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        at = min((k for k, r in enumerate(rooms) if r >= s), key=lambda k: rooms[k], default=None)
        if at is None:
            rooms.append(capacity)
            at = len(rooms) - 1
        rooms[at] -= s
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    random = np.random.RandomState(seed)
    sizes = random.choice([random.randint(1, 129, 700), random.randint(1, 20, 700), random.randint(40, 90, 700)][seed % 3], 500)
    histogram = np.bincount(sizes, minlength=129)
    p, rows = placed(histogram)
    assert len(rows) == len(sizes) and sorted(r[2] for r in rows) == sorted(sizes)
    end, at = 0, -1
    for sequence, offset, length in rows:
        if sequence != at:
            assert sequence == at + 1
            at, end = sequence, 0
        assert offset == end
        end += length
        assert end <= 128
    assert p.sequences == at + 1 and p.sequences <= 1.02 * least(sizes.tolist(), 128) + 1


def test_fit_finds_the_patterns_of_a_mixture():
    parts = packing.patterns(32)
    wanted = np.zeros(33)
    for a, b, c, times in ((20, 12, 0, 40), (16, 8, 8, 25), (32, 0, 0, 10)):
        for x in (a, b, c):
            wanted[x] += times
    wanted[0] = 0
    x = packing.fit_counts(wanted, parts)
    uses = sum(np.bincount(p, weights=x, minlength=33) for p in parts)
    assert (x >= 0).all() and np.abs(uses[1:] - wanted[1:]).max() < 0.5 and abs(x.sum() - 75) < 1


def test_pieces_and_sequences(spark, odd, tokenizer):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    pieces = packing.token_pieces(odd, tokenizer, capacity=64)
    packed = packing.pack(pieces, capacity=64)
    rows = packed.collect()
    want = sorted([*plain.encode(r.text or "", add_special_tokens=False).ids, 0] for r in odd.collect())
    held = []
    for r in sorted(pieces.collect(), key=lambda r: (str(r.doc_id), r.start)):
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and (r.length == 64 or r.piece == 0)
    assert sum(len(w) for w in want) == sum(r.length for r in rows)
    assert sum(-(-len(w) // 64) for w in want) == len(rows)
    for s in packing.sequences(packed).collect():
        assert len(s.ids) == sum(s.lengths) <= 64
        held += list(s.ids)
    assert sorted(held) == sorted(x for w in want for x in w)
    total = sum(len(w) for w in want)
    assert len({r.sequence_id for r in rows}) <= -(-total // 64) + 1


def test_extra_columns_and_ties(spark):
    df = spark.createDataFrame([(None, 0, 5, "x"), (None, 0, 5, "x"), (1, 0, 16, None), (1, 0, 16, "y")], "doc_id long, piece int, length long, offset string")
    got = packing.pack(df, capacity=16).collect()
    assert len(got) == 4 and {r.offset for r in got} == {0, 5} and len({r.sequence_id for r in got}) == 3


@pytest.mark.parametrize("length", [0, 17, None])
def test_pieces_that_do_not_fit(spark, length):
    df = spark.createDataFrame([(1, 0, length)], "doc_id long, piece int, length long")
    with pytest.raises(Exception, match="Pieces need 1 to 16 tokens"):
        packing.pack(df, capacity=16).collect()


def test_empty_table(none, tokenizer):
    assert packing.pack(packing.token_pieces(none, tokenizer)).collect() == []
