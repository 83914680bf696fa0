import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from bitext.llm import ctw


def slow_weights(train, depth):
    """Trees as dictionaries, one bit at a time: (context, bits so far) to counts."""
    counts = defaultdict(lambda: [0, 0])
    for t in train:
        raw = bytes(depth) + t + b"\xff"
        for i in range(depth, len(raw)):
            for d in range(depth + 1):
                for k in range(8):
                    node = (raw[i - d : i], (1 << k) | (raw[i] >> (8 - k)))
                    counts[node][(raw[i] >> (7 - k)) & 1] += 1
    return counts


def slow_bits(text, counts, depth):
    """Code length of a text: predict every bit by the ratio of weighted probabilities, recursively."""
    children = defaultdict(set)
    for context, node in counts:
        if context:
            children[context[1:], node].add(context)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    memo = {}

    def weighted(context, node):
        if (context, node) not in memo:
            own = kt(*counts[context, node])
            if len(context) < depth:
                below = sum(weighted(c, node) for c in children[context, node])
                own = np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)
            memo[context, node] = own
        return memo[context, node]

    def one(path, node):
        context = path[0]
        if (context, node) not in counts:
            return 0.5
        a, b = counts[context, node]
        own = (b + 0.5) / (a + b + 1)
        if len(path) == 1:
            return own
        share = math.exp(math.log(0.5) + kt(a, b) - weighted(context, node))
        return share * own + (1 - share) * one(path[1:], node)

    raw, bits = bytes(depth) + text + b"\xff", 0.0
    for i in range(depth, len(raw)):
        for k in range(8):
            p = one([raw[i - d : i] for d in range(depth + 1)], (1 << k) | (raw[i] >> (8 - k)))
            bits -= math.log2(p if (raw[i] >> (7 - k)) & 1 else 1 - p)
    return bits


def texts(n, seed):
    random.seed(seed)
    return [" ".join(random.choices(["the", "theatre", "ant", "tant", "é", "on"], k=random.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("depth", [3, 5])
def test_scores_equal_the_recursion(spark, depth):
    rows = [(k, t) for k, t in enumerate(texts(60, 1))] + [(None, "The ant"), (100, None), (100, ""), (101, "THEATRE zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ctw.score_texts(docs, depth=depth).collect()
    assert len(got) == len(rows)
    out = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    counts = slow_weights([low(t).encode() for i, t in rows if not out(i)], depth)
    words = Counter(w for i, t in rows if not out(i) for w in [*low(t).split(), "\n"])
    n, v = sum(words.values()), len(words)
    want = {}
    for i, t in rows:
        w = [*low(t).split(), "\n"]
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w)
        bits = slow_bits(low(t).encode(), dict(counts), depth)
        want.setdefault(i, []).append((out(i), len(w), sum(x in words for x in w), n, base, -bits * math.log10(2)))
    for r in got:
        found = (r.held_out, r.n_tokens, r.n_known, r.train_tokens)
        near = [x for x in want[r.doc_id] if x[:4] == found and abs(x[4] - r.base_score) < 1e-6 and abs(x[5] - r.score) < 1e-3]
        assert near, (r, want[r.doc_id])


def test_probabilities_sum_to_one():
    codes, counts = np.unique(np.concatenate([ctw.codes_of(t.encode(), 4) for t in texts(30, 2)]), return_counts=True)
    levels = [ctw.leaves(codes, counts)]
    for d in range(4, 0, -1):
        levels.append(ctw.raise_level(levels[-1], d))
    mixed = []
    for d, level in enumerate(reversed(levels)):
        mixed.append(ctw.mix_down(level, mixed[-1] if mixed else None, d, d == 4))
    for context in (b"the ", b"zzzz", b"\x00\x00\x00\x00", b"zhe "):
        all_ = (np.uint64(int.from_bytes(context, "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs(np.exp2(-ctw.code_lengths(all_, mixed, 4)).sum() - 1) < 1e-9


def test_held_out_texts_cost_less_than_even_bits(spark):
    docs = spark.createDataFrame([(k, t + ".") for k, t in enumerate(texts(400, 3))], "doc_id long, text string")
    held = [r for r in ctw.score_texts(docs).collect() if r.held_out]
    assert len(held) > 20 and np.mean([r.bits_per_byte for r in held]) < 2.2


@pytest.mark.parametrize("a,b", [(0, 0), (3, 5), (20_000, 1), (100_000, 250_000)])
def test_estimate(a, b):
    want = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    assert abs(ctw.kt(np.array([a]), np.array([b]))[0] - want) < 1e-6 * max(1, abs(want))


def test_odd_rows(odd):
    got = ctw.score_texts(odd).collect()
    assert len(got) == odd.count() and all(r.score < 0 and r.n_tokens >= 1 for r in got)


def test_nothing_to_learn_from(spark):
    only = next(k for k in range(50) if zlib.crc32(str(k).encode()) % 7 == 2)
    one, = ctw.score_texts(spark.createDataFrame([(only, "ab")], "doc_id long, text string")).collect()
    assert one.train_tokens == 0 and one.base_score == 0 and abs(one.score + 24 * math.log10(2)) < 1e-5


def test_empty_table(none):
    assert ctw.score_texts(none).collect() == []
