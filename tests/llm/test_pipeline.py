import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from bitext.llm import common, forest, jaccard, packing, queries
from checks.compare import ROOT, compare

SMALL = f"{ROOT}/sf0.001"
NAMES = [f"op{k}_" for k in range(1, 14)]


def test_registry():
    found = entry.queries()
    assert [n for n in NAMES if sum(q.startswith(n) for q in found) != 1] == [] and found["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "mixture", "pack"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    ok, message = compare(spark, name, queries.QUERIES[name], queries.SQL[name], SMALL)
    assert ok, message


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    random.seed(8)
    path = str(tmp_path_factory.mktemp("tables"))
    words = ["".join(random.choices("abcdefghij", k=random.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for k in range(300):
        text = " ".join(random.choices(words, k=random.randint(12, 90)))
        if k % 10 == 0 and docs:
            text = docs[-1][1] + " end"
        bad = k % 12 == 0
        if bad:
            text = " ".join(w + "###" for w in text.split())
        docs.append((k, text, "en", random.choice("aaab") if k % 30 else None, len(text)))
        labels.append((k, 0 if bad else 1, 0))
    docs += [(300, None, None, None, None), (301, "", "en", "a", 0), (None, " ".join(random.choices(words, k=40)), None, "b", 3), docs[5]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_plain_versions(spark, folder, tokenizer):
    docs = queries.table(spark, folder, "documents")
    stage = dict(corpus_pipeline.STAGES)
    # 1: rows whose statistics the forest keeps, judged one text at a time.
    made = forest.fit_forest(docs, queries.table(spark, folder, "labels"))
    good = common.staged(stage["quality"](spark, docs, folder))
    want = []
    for r in docs.collect():
        counts, features = forest.statistics(r.text)
        if not forest.base_failed(counts) and made.scores(forest.np.array([features]))[0] <= made.threshold:
            want.append(tuple(r))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in good.collect()) and good.columns == docs.columns
    assert not any("###" in r.text for r in good.collect())
    # 2: of all components by pairs, the least identifier.
    one = common.staged(stage["near_copies"](spark, good, folder))
    rows = good.collect()
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    least = list(range(len(rows)))
    # Of equal identifiers any may stand for a component; here the one the stage kept.
    chosen = {tuple(r) for r in one.collect()}
    key = [(r.doc_id is None, r.doc_id or 0, tuple(r) not in chosen) for r in rows]
    for _ in rows:
        new = [min((least[j] for j in range(len(rows)) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])), key=lambda j: key[j]) for i in range(len(rows))]
        if new == least:
            break
        least = new
    assert sorted(map(str, {tuple(rows[j]) for j in least})) == sorted(str(tuple(r)) for r in one.collect())
    # 3: copies as the mix says, at most three of each.
    mixed = common.staged(stage["mixture"](spark, one, folder))
    sizes = one.groupBy("source").agg(F.sum(common.n_words(F.col("text"))).alias("n")).collect()
    taken = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(common.n_words(F.col("text"))).alias("n")).collect()}
    assert mixed.columns == docs.columns and mixed.groupBy(*docs.columns).count().agg(F.max("count")).first()[0] <= 3
    assert abs(sum(taken.values()) - sum(r.n for r in sizes)) < 0.1 * sum(r.n for r in sizes)
    # 4: every row's ids, in sequences of at most 2048.
    packed = stage["pack"](spark, mixed, folder).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    assert sum(r.length for r in packed) == sum(len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    total = {}
    for r in packed:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert max(total.values()) <= 2048


def test_documents_without_or_under_one_identifier_stay(spark, folder):
    rows = [(7, "one text of some words here", "en", "a", 1), (7, "quite another text under that identifier", "en", "a", 1),
            (None, "a third text that has no identifier", "en", "a", 1), (None, "and a fourth one that has none either", None, None, None),
            (None, "and a fourth one that has none either", None, None, None), (9, "one text of some words here", "en", "b", 1), (None, None, None, None, None), (3, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_copies(spark, docs, folder).collect()
    assert sorted(map(str, {r[:2] for r in rows if r[0] != 9})) == sorted(str((r.doc_id, r.text)) for r in got) and len(got) == len(set(rows)) - 1


def test_run_equals_its_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    found = rows.collect()
    assert found and {"doc_id", "piece", "sequence_id", "offset", "ids"} <= set(rows.columns)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in found)
    # What the stages wrote on the way is gone; what is read is there.
    left = os.listdir(common.checkpoint_folder(spark).removeprefix("file:"))
    assert [n for n in left if n.startswith(("quality-", "near_copies-", "mixture-"))] == [] and any(n.startswith("pack-") for n in left)
    for s in packing.sequences(rows).collect():
        assert len(s.ids) == sum(s.lengths) <= 2048


def test_empty_tables(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_links_are_not_collected(spark, folder):
    found = jaccard.link_similar(queries.table(spark, folder, "documents"))
    assert found.columns == ["doc_id", "n_shingles", "n_links", "component_id"]
