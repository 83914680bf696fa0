import hashlib
import random
import zlib

import numpy as np
import pytest

from bitext.llm import periods, queries


def runs(words):
    """All runs by trying every period at every place."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        k = q
        while k < n:
            if words[k] != words[k - q]:
                k += 1
                continue
            lo = k
            while k < n and words[k] == words[k - q]:
                k += 1
            start, length = lo - q, k - lo + q
            smaller = any(all(words[i] == words[i - d] for i in range(start + d, start + length)) for d in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((start, length, q))
    return sorted(out)


def collapse(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(seed):
    """Texts with repeats of all sizes, next to and inside one another."""
    r = random.Random(seed)
    words = []
    for _ in range(r.randint(0, 8)):
        unit = [r.choice("abcdefgh"[: r.randint(1, 8)]) for _ in range(r.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 33]))]
        if r.random() < 0.3:
            unit = unit * r.randint(2, 5) + [r.choice("xyz")]
        words += (unit * r.randint(1, 7))[: r.randint(1, 200)]
    return words


@pytest.mark.parametrize("seed", range(150))
def test_runs_like_brute_force(seed):
    r = random.Random(1000 + seed)
    texts = [made(7 * seed + k) for k in range(r.randint(1, 4))]
    numbers = {w: k for k, w in enumerate("abcdefghxyz")}
    flat = np.array([numbers[w] for t in texts for w in t], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    places, lags = periods.openings(flat, bounds)
    for k, words in enumerate(texts):
        mine = (places >= bounds[k]) & (places < bounds[k + 1])
        opened = list(zip((places[mine] - bounds[k]).tolist(), lags[mine].tolist(), strict=True))
        assert periods.runs_of([numbers[w] for w in words], opened) == runs(words)


@pytest.mark.parametrize("letters", [2, 3])
def test_short_random_words(letters):
    r = random.Random(letters)
    for _ in range(400):
        words = [r.randrange(letters) for _ in range(r.randint(0, 60))]
        places, lags = periods.openings(np.array(words, dtype=np.int64), np.array([0, len(words)]))
        assert periods.runs_of(words, list(zip(places.tolist(), lags.tolist(), strict=True))) == runs(words)


def test_rows(spark, odd):
    docs = odd.unionByName(spark.createDataFrame(
        [(8, "a\x1fb a\x1fb a\x1fb\ta\x1fb  a\x1fb\n a\x1fb end", "en", "a", 1, "x"), (9, "so " * 40 + "it goes on " * 9, "en", "a", 1, "x"), (10, " lead a a a a a a ", "en", "a", 1, "x")],
        odd.schema,
    ))
    got = periods.find_runs(docs.withColumn("runs", docs.n_chars)).collect()
    assert sorted(got[0].asDict()) == sorted(["doc_id", "lang", "source", "n_chars", "taken", "n_words", "runs", "longest", "collapsed"])
    by_place = {r.taken: r for r in got if r.taken != "x"}
    for r in docs.collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        want = runs(words) if len(words) < 1000 else None
        for g in [by_place[r.taken]] if r.taken != "x" else [g for g in got if g.doc_id == r.doc_id and g.taken == "x"]:
            assert g.n_words == len(words)
            if want is not None:
                assert [tuple(x) for x in g.runs] == want and g.collapsed == collapse(words, want)
                longest = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else None
                assert (tuple(g.longest) if g.longest else None) == longest


def test_empty_table(none):
    assert periods.find_runs(none).collect() == []


def test_long_texts(spark):
    texts = {1: ["w"] * 200_000, 2: [f"w{k % 40_000}" for k in range(200_000)], 3: [f"w{k}" for k in range(200_000)]}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periods.find_runs(docs).collect()}
    assert got == {1: [(0, 200_000, 1)], 2: [(0, 200_000, 40_000)], 3: []}


def test_query(spark, tmp_path):
    r = random.Random(3)
    rows = [(k, " ".join(r.choice(["so", "it", "goes", "on", "and", "ever"]) for _ in range(r.randint(0, 90)))) for k in range(300)]
    rows += [(None, "so so so so so so so"), (301, None), (302, "  "), (10, "repeated row of ten"), (10, "repeated row of ten")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def want(i, text):
        words = (text or "").split()
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len((text or "").split())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        found = runs(words)
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
        return (
            i, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(collapse(words, found).encode()).hexdigest(),
        )

    got = queries.op12_periods(spark, str(tmp_path)).collect()
    key = lambda x: [(v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in x]
    assert sorted(map(tuple, got), key=key) == sorted((want(i, t) for i, t in rows), key=key)
