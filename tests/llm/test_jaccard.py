import random
import re

from bitext.llm import jaccard


def brute(rows, width=5, percent=75):
    """(id, n_shingles, n_links, component) by comparing every pair."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    near = [[j for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= percent * len(a | b)] for i, a in enumerate(sets)]
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((key, len(sets[i]), len(near[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return out


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_random_near_copies(spark):
    random.seed(5)
    words = [f"w{k}" for k in range(60)]
    base = [random.choices(words, k=random.randint(3, 70)) for _ in range(25)]
    rows = []
    for k in range(220):
        w = list(random.choice(base))
        for _ in range(random.randint(0, 4)):
            w[random.randrange(len(w))] = random.choice(words)
        rows.append((k * 7 % 220, " ".join(w).title() if k % 5 == 0 else "  ".join(w)))
    rows += [(1000 + k, None if k % 2 else " ") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert order(jaccard.link_similar(docs).collect()) == order(brute(rows))


def test_small_tiles_give_the_same(spark, monkeypatch):
    random.seed(6)
    base = [f"b{k}" for k in range(40)]
    rows = []
    for k in range(150):
        w = list(base)
        w[random.randrange(40)] = f"x{random.randrange(6)}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(jaccard, "TILE", 2000)
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert order(jaccard.link_similar(docs).collect()) == order(brute(rows))


def test_chain_is_one_component(spark):
    # Neighbours share 24 of 26 windows, the ends nothing.
    text = [f"t{k}" for k in range(400)]
    rows = [(500 - k, " ".join(text[2 * k : 2 * k + 40])) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert order(jaccard.link_similar(docs).collect()) == order(brute(rows))


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert order(jaccard.link_similar(odd).collect()) == order(brute(rows))


def test_rows_without_identifier(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "g h i j k l"), (None, "g h i j k l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert order(jaccard.link_similar(docs).collect()) == order(brute(rows))


def test_one_identifier_under_several_texts(spark):
    a, b = [f"a{k}" for k in range(30)], [f"b{k}" for k in range(30)]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (2, " ".join([*a, "more"])), (9, " ".join([*b[:20], *a[:9]])), (5, "five words of one text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert order(jaccard.link_similar(docs).collect()) == order(brute(rows))


def test_repeated_identifiers_and_a_common_shingle(spark):
    random.seed(8)
    words, common = [f"w{k}" for k in range(50)], "this passage stands in every text here"
    base = [random.choices(words, k=random.randint(8, 40)) for _ in range(12)]
    rows = []
    for _ in range(160):
        w = list(random.choice(base))
        w[random.randrange(len(w))] = random.choice(words)
        rows.append((random.randrange(40), " ".join(w) + " " + common))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert order(jaccard.link_similar(docs).collect()) == order(brute(rows))


def test_empty_table(none):
    assert jaccard.link_similar(none).collect() == []


def test_very_long_text_between_near_copies(spark):
    # All in one block; the long text makes its counts wide although each of them is small.
    near = [[f"n{k}w{i}" for i in range(60)] for k in range(12)]
    rows = [(k, " ".join(w)) for k, w in enumerate(near)]
    rows.append((100, " ".join(f"long{i}" for i in range(70_000))))
    rows += [(200 + k, " ".join([*w[:-1], "other"])) for k, w in enumerate(near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert order(jaccard.link_similar(docs).collect()) == order(brute(rows))
