import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitext.llm import parsing


def text_of(n, seed):
    random.seed(seed)
    return " ".join("".join(random.choices("abcdefgh", k=random.randint(1, 9))) for _ in range(n))


def test_equal_substrings_share_interior_phrases():
    middle = text_of(300, 1)
    for lead in ("", "x", text_of(7, 2), text_of(40, 3)):
        a, b = parsing.phrases([middle.encode(), (lead + middle + text_of(5, 4)).encode()])
        a = a.tolist()
        common = set(a) & set(b.tolist())
        # All but the phrases near the ends.
        assert sum(x in common for x in a) >= len(a) - 6


def test_phrases_do_not_depend_on_the_batch():
    texts = [text_of(k, k) for k in range(30)] + ["", "a", "aa", "aaaaaaaaaaaaaaaaaaaa", "ab" * 500, "é" * 3]
    alone = [parsing.phrases([t.encode()])[0].tolist() for t in texts]
    assert alone == [p.tolist() for p in parsing.phrases([t.encode() for t in texts])]


def test_phrases_are_short_and_long_enough():
    text = text_of(4000, 9).encode()
    for level in (1, 2, 3):
        mean = len(text) / len(parsing.phrases([text], level)[0])
        assert 2.0**level <= mean <= 5.0**level


def test_likeness_follows_the_common_share():
    a = text_of(1500, 11)
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        cut = int(len(a) * share)
        b = a[:cut] + text_of(1500, 12)[: len(a) - cut]
        s = parsing.sketches([a, b])
        assert abs(parsing.likeness(s[:1], s[1:])[0] - share) < 0.2
    assert parsing.likeness(*[parsing.sketches([""])] * 2)[0] == 1.0


def test_unrelated_long_texts_are_not_alike():
    random.seed(21)
    a, b = (random.randbytes(10_000_000).hex() for _ in range(2))
    s = parsing.sketches([a, b])
    assert parsing.likeness(s[:1], s[1:])[0] < 0.05


M = (1 << 64) - 1


def mixed(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M
    return h ^ (h >> 31)


def power(k):
    return pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)


def tossed(symbols, bits):
    """Twice the place of the lowest bit that differs from the left neighbour, plus the bit there."""
    out = []
    for k, x in enumerate(symbols):
        other = symbols[k - 1] if k else (1 << bits) - 1
        place = next((b for b in range(bits) if (x ^ other) >> b & 1), bits)
        out.append(2 * place + (x >> min(place, bits - 1) & 1))
    return out


def level(names):
    """Phrases of one level, one symbol at a time."""
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    names = [x if n == 1 else mixed((x + n * power(7)) & M) for x, n in runs]
    labels = tossed(names, 64)
    for _ in range(3):
        labels = tossed(labels, 8)
    opens = [k for k in range(len(names)) if k == 0 or (k + 1 < len(names) and labels[k - 1] < labels[k] > labels[k + 1])]
    return [mixed(sum(names[k] * power((k - lo) & 255) for k in range(lo, hi)) & M) for lo, hi in zip(opens, [*opens[1:], len(names)], strict=True)]


def sketch(text):
    names = [mixed((b + 1) * power(0) & M) for b in text.encode()]
    for _ in range(parsing.LEVELS):
        names = level(names) if names else []
    bins = {}
    for x in names:
        h = mixed((x + power(3)) & M)
        bins[h % parsing.BINS] = min(h, bins.get(h % parsing.BINS, M))
    return [max(mixed((bins[k] + power(4)) & M) >> 48, 1) if k in bins else 0 for k in range(parsing.BINS)]


def test_sketches_like_one_symbol_at_a_time():
    texts = ["", "a", "ab", "aaaa", "é" * 5, "abababab" * 9, "one two  two\n" * 7, *[text_of(k, 100 + k) for k in (1, 2, 3, 9, 40, 200)]]
    assert parsing.sketches(texts).tolist() == [sketch(t) for t in texts]
    for a in texts[3:9]:
        for b in texts[5:]:
            x, y = sketch(a), sketch(b)
            used, hits = sum(p or q for p, q in ((i > 0, j > 0) for i, j in zip(x, y, strict=True))), sum(i == j > 0 for i, j in zip(x, y, strict=True))
            assert parsing.likeness(parsing.sketches([a]), parsing.sketches([b]))[0] == (2 * hits / (used + hits) if used else 1.0)


def brute(rows):
    texts = [t or "" for _, t in rows]
    out = []
    for k, (i, _) in enumerate(rows):
        x, y = texts[k], texts[(k + 1) % len(rows)]
        half = len(x) // 2
        edited = x[: len(x) - half] + y[:half]
        s = parsing.sketches([x, edited, y])
        out.append((
            i, len(x), hashlib.sha256(edited.encode()).hexdigest(), parsing.to_text(s[:1])[0], parsing.to_text(s[1:2])[0],
            parsing.likeness(s[:1], s[1:2])[0], parsing.likeness(s[:1], s[2:])[0],
        ))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_pairs_follow_the_order(spark, parts):
    rows = [(k, text_of(k % 50, k) if k % 9 else None) for k in range(120, 0, -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert sorted(map(tuple, parsing.edited_pairs(docs).collect()), reverse=True) == brute(rows)


def test_odd_rows(odd):
    got = parsing.edited_pairs(odd).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_chars) for r in got if r.doc_id) == sorted((False, r.doc_id, len(r.text or "")) for r in odd.collect() if r.doc_id)
    assert len(got) == odd.count()
    twice = [r for r in got if r.doc_id == 1]
    assert twice[0].fingerprint == twice[1].fingerprint and sorted(r.near_next == 1.0 for r in twice)[-1]
    marked = parsing.with_fingerprint(odd, out="taken")
    assert marked.columns == odd.columns and marked.where("text = ''").first().taken == "0" * 4 * parsing.BINS
    pairs = marked.select("taken", F.col("taken").alias("b")).withColumn("l", parsing.likeness_column("taken", "b"))
    assert {r.l for r in pairs.collect()} == {1.0}


def test_one_row_and_no_row(spark, none):
    one, = parsing.edited_pairs(spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0
    assert parsing.edited_pairs(none).collect() == []


def test_long_runs():
    found = parsing.phrases([b"a" * 100_000, b"a" * 100_001])
    assert len(found[0]) == 1 and not np.array_equal(found[0], found[1])
