import collections
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from bitext.llm import windows


def served(lengths, weights, capacity, grain):
    """Deficit round-robin, one round after the other with exact numbers: (queue, first, end) in the order of sending."""
    left, credit, sent, out = [Fraction(n) for n in lengths], [Fraction(0)] * len(lengths), [0] * len(lengths), []
    while sum(sent) < sum(lengths):
        budget = min(Fraction(capacity), sum(left))
        while budget:
            going = [k for k, n in enumerate(left) if n]
            share = min([budget / sum(weights[k] for k in going), *[left[k] / weights[k] for k in going]])
            for k in going:
                credit[k] += share * weights[k]
                left[k] -= share * weights[k]
            budget -= share * sum(weights[k] for k in going)
        for k, n in enumerate(lengths):
            upto = n if not left[k] else int(credit[k] // grain) * grain
            if upto > sent[k]:
                out.append((k, sent[k], upto))
                sent[k] = upto
    return out


def placed(rounds, queue, n):
    tokens, of = np.arange(n), np.full(n, queue)
    number = rounds.round_of(of, tokens)
    return rounds.begins(of, number) + tokens - rounds.sent(of, number - 1)


@pytest.mark.parametrize("seed", range(30))
def test_rounds_like_the_simulation(seed):
    r = random.Random(seed)
    capacity, grain, k = r.choice([16, 64]), r.choice([1, 4, 8]), r.choice([1, 2, 4, 5, 6])
    exact = seed % 2 == 0
    # Two or four queues of equal weight: doubles hold all shares exactly.
    weights = [Fraction(1)] * k if exact else [Fraction(r.randint(1, 40), 7) for _ in range(k)]
    lengths = [32 * r.randint(1, 9)] * k if exact else [r.randint(0, 400) for _ in range(k)]
    rounds = windows.Rounds(lengths, [float(w) for w in weights], capacity, grain)
    want, at = [np.full(n, -1) for n in lengths], 0
    for queue, lo, hi in served(lengths, weights, capacity, grain):
        want[queue][lo:hi] = at + np.arange(hi - lo)
        at += hi - lo
    got = [placed(rounds, queue, n) for queue, n in enumerate(lengths)]
    assert sorted(np.concatenate(got).tolist()) == list(range(sum(lengths)))
    for g, w in zip(got, want, strict=True):
        # A share that meets a grain exactly may come a round later.
        assert len(g) == 0 or (np.abs(g - w).max() <= (0 if exact and k in (1, 2, 4) else k * grain + capacity) and (np.diff(g) > 0).all())


def test_cuts():
    for total in (0, 1, 63, 64, 65, 1000, 1023):
        cuts = windows.Cuts(total, 64)
        place = np.arange(total)
        sizes = collections.Counter(cuts.window(place).tolist())
        assert sorted(sizes) == list(range(len(sizes))) and all(n == 64 or n & (n - 1) == 0 for n in sizes.values())
        assert sum(n != 64 for n in sizes.values()) <= 6
        assert all(0 <= x for x in (place - cuts.begin(cuts.window(place))).tolist())


def checked(rows, texts, tokenizer, capacity):
    """Every id in one piece, sequences without gaps and full up to powers of two."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    held, made = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        held[r.sequence_id].append((r.offset, r.length))
        made[(r.doc_id, r.doc_tokens)].append((r.start, ids))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == capacity or (end < capacity and end & (end - 1) == 0)
    want = collections.Counter()
    for i, t in texts:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want[(i, len(ids))] += len(ids)
    assert {k: sum(len(x) for _, x in v) for k, v in made.items()} == dict(want)
    for i, t in texts:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for start, some in made[(i, len(ids))]:
            if want[(i, len(ids))] == len(ids):
                assert ids[start : start + len(some)] == some
    return held


def test_odd_rows(spark, odd, tokenizer):
    rows = windows.pack_mixture(odd, tokenizer, capacity=64).collect()
    checked(rows, [(r.doc_id, r.text) for r in odd.collect()], tokenizer, 64)
    assert {r.source for r in rows} == {"a", "b", None, "", "c"}


def test_empty_table(none, tokenizer):
    assert windows.pack_mixture(none, tokenizer).collect() == []


def corpus(spark):
    r = random.Random(5)
    words = ["the", "of", "tokens", "window", "source", "deficit", "share", "mix"]
    rows = [
        (k, " ".join(r.choice(words) for _ in range(r.randint(0, 120))), r.choices(["web", "code", "books", None, "rare"], [60, 25, 12, 8, 1])[0])
        for k in range(1500)
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), rows


def test_windows_hold_the_mixture(spark, tokenizer):
    docs, texts = corpus(spark)
    rows = windows.pack_mixture(docs, tokenizer, capacity=512, grain=8).collect()
    held = checked(rows, [(i, t) for i, t, _ in texts], tokenizer, 512)
    tokens, total = collections.Counter(), 0
    for r in rows:
        tokens[r.source] += r.length
        total += r.length
    share = collections.defaultdict(collections.Counter)
    for r in rows:
        share[r.sequence_id][r.source] += r.length
    full = [s for s in held if sum(n for _, n in held[s]) == 512]
    assert len(full) >= total // 512
    for s in full:
        for source, n in tokens.items():
            assert abs(share[s][source] - 512 * n / total) <= 5 * 8


def test_targets_and_dry_queues(spark, tokenizer):
    docs, texts = corpus(spark)
    rows = windows.pack_mixture(docs, tokenizer, capacity=512, grain=8, weights={"web": 1, "code": 1, "books": 2}).collect()
    checked(rows, [(i, t) for i, t, _ in texts], tokenizer, 512)
    share = collections.defaultdict(collections.Counter)
    for r in rows:
        share[r.sequence_id][r.source] += r.length
    books = max(s for s in share if share[s]["books"])
    for s in range(1, books - 1):
        assert abs(share[s]["books"] - 256) <= 24 and abs(share[s]["web"] - 128) <= 24 and abs(share[s]["code"] - 128) <= 24
    named = max(s for s in share if share[s]["web"] or share[s]["code"])
    assert min(s for s in share if share[s][None] or share[s]["rare"]) >= named - 1


def test_many_sources_share_a_queue(spark, tokenizer):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text number ', id) AS text", "cast(id % 90 AS string) AS source").repartition(3)
    rows = windows.pack_mixture(docs, tokenizer, capacity=128, queues=8).collect()
    checked(rows, [(k, f"text number {k}") for k in range(400)], tokenizer, 128)


def test_long_text(spark, tokenizer):
    text = "many words of one long text " * 30_000
    docs = spark.createDataFrame([(1, text, "a"), (2, "short", "a"), (3, "other", "b")], "doc_id long, text string, source string")
    rows = windows.pack_mixture(docs, tokenizer).collect()
    checked(rows, [(1, text), (2, "short"), (3, "other")], tokenizer, 2048)


def test_query_digests(spark, odd, tokenizer):
    rows = windows.pack_mixture(odd, tokenizer, capacity=64).selectExpr("ids", "crc32(ids) AS c").collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.c for r in rows)
