import numpy as np

from bitext.llm import forest, queries


def slow_repeats(words):
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    hit = set()
    for k, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(k, k + 5))
    return len(hit)


def test_repeated_words():
    random = np.random.RandomState(1)
    for n in (0, 4, 5, 6, 9, 40, 120):
        for kinds in (1, 2, 3, 8):
            words = [f"w{random.randint(kinds)}" for _ in range(n)]
            assert forest.repeated_words(words) == slow_repeats(words)


def test_statistics_of_a_text():
    text = "One  two\n\nOne  two\n#*$ ab\n \nOne  two\xa0x"
    (n, chars, symbols, dup, repeat), features = forest.statistics(text)
    assert (n, chars, symbols, dup, repeat) == (8, 6 + 6 + 5 + 8, 3, 1, 0) and len(features) == len(forest.FEATURES)
    assert forest.statistics(None)[0] == forest.statistics("")[0] == [0, 0, 0, 0, 0]


def test_path_lengths_by_walking_down():
    random = np.random.RandomState(2)
    rows = random.rand(300, 3)
    made = forest.Forest.fit(rows, trees=10, sample=64)
    points = np.concatenate([random.rand(20, 3), [[5, 5, 5]]])
    for p, score in zip(points, made.scores(points), strict=True):
        depth = 0.0
        for t in range(10):
            node = 0
            while made.left[t, node] != node:
                node = made.left[t, node] + (p[made.feature[t, node]] >= made.split[t, node])
            depth += made.depth[t, node]
        assert abs(score - 2 ** (-depth / 10 / float(forest._mean_path(64)))) < 1e-9


def test_outliers_stand_out():
    random = np.random.RandomState(3)
    good, bad = random.normal(0.2, 0.02, (500, 4)), random.normal(0.8, 0.02, (50, 4))
    both = np.concatenate([good, bad])
    made = forest.Forest.fit(good[:300], np.stack([both.min(0), both.max(0)]))
    made.calibrate(good[:300], bad[:25], 0.01)
    assert (made.scores(bad[25:]) > made.threshold).all() and (made.scores(good[300:]) > made.threshold).mean() < 0.03


def corpus(spark):
    random = np.random.RandomState(4)
    rows, labels = [], []
    for k in range(400):
        words = ["".join(random.choice(list("abcdefgh"), random.randint(2, 9))) for _ in range(60)]
        bad = k % 8 == 0
        rows.append((k, " ".join(w + ("$$$" if bad else "") for w in words)))
        labels.append((k, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_documents(spark):
    docs, labels = corpus(spark)
    made = forest.fit_forest(docs, labels.where("doc_id < 200"))
    kept = {r.doc_id: r.kept for r in forest.judge(docs, made).where("doc_id >= 200").collect()}
    good = [kept[k] for k in kept if k % 8]
    assert np.mean(good) > 0.97 and not any(kept[k] for k in kept if k % 8 == 0)


def test_fit_is_repeatable_and_bounded(spark):
    docs, labels = corpus(spark)
    one, two = (forest.fit_forest(docs.repartition(n), labels.repartition(n), label_rows=100) for n in (1, 4))
    assert one.threshold == two.threshold and np.array_equal(one.split, two.split)


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (6, 1), (7, 0), (2, 1)], "doc_id long, quality int")
    for made in (None, forest.fit_forest(odd, labels)):
        got = forest.judge(odd, made)
        rows = got.collect()
        assert len(rows) == odd.count() and "taken" in got.columns
        assert all(not r.kept for r in rows if r.base_failed) and all(r.base_failed for r in rows if not r.text)
    assert forest.fit_forest(none, labels) is None and forest.fit_forest(odd, labels.limit(0)) is None
    assert forest.judge(none, None).collect() == []


def test_two_texts_under_a_labelled_identifier(spark):
    docs, labels = corpus(spark)
    more = docs.where("doc_id < 60").selectExpr("doc_id", "concat('another text under it ', text) AS text")
    both, swapped = (a.unionByName(b).coalesce(1) for a, b in ((docs, more), (more, docs)))
    one, two = (forest.fit_forest(d, labels) for d in (both, swapped))
    assert one.threshold == two.threshold and np.array_equal(one.split, two.split)


def slow_counts(text):
    """The five counts, by the words of their definition."""
    split = lambda t: [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
    words, seen, dup = split(text or ""), set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, slow_repeats(words))


def test_query_counts_and_plain_rules(spark, tmp_path):
    random = np.random.RandomState(6)
    marks = [" ", "\n", "  ", "\t", "\x1f", "\xa0", "a", "bc", "#", "é😀", "one two three four five ", "$%"]
    texts = [None, "", "\n\n", *["".join(random.choice(marks, random.randint(1, 80))) for _ in range(120)]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 3 // 2) for k in range(0, 120, 2)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for r in queries.op7_quality(spark, str(tmp_path)).collect():
        want = slow_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)


def test_all_labels_count(spark):
    docs, _ = corpus(spark)
    many = docs.crossJoin(spark.range(21).withColumnRenamed("id", "copy")).selectExpr("doc_id + 400 * copy AS doc_id", "concat(text, ' w', copy * 7 + doc_id) AS text")
    labels = many.selectExpr("doc_id", "CASE WHEN doc_id % 8 = 0 THEN 0 ELSE 1 END AS quality")
    made = forest.fit_forest(many, labels)
    assert made.labelled == 8_400
    rows = [(forest.statistics(r.text)[1], r.doc_id % 8) for r in many.collect()]
    good, bad = (np.array([f for f, kind in rows if bool(kind) == want]) for want in (True, False))
    threshold = made.threshold
    made.calibrate(good, bad, 0.001)
    assert made.threshold == threshold
