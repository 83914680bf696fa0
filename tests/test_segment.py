import random

import pytest
from pyspark.sql import functions as F

from bitext import constants as K
from bitext.operators import segment as S


def pages(spark, *rows):
    return spark.createDataFrame(
        [(1, *r[:3], *(r[3] if len(r) > 3 else (0, 0))) for r in rows],
        "doc_id long, page int, method string, text string, image_count int, vector_path_count int",
    )


def segments(df):
    return [(r.segment_id, r.page, r.block_type, r.text) for r in S.segment_pages(df).orderBy("ordinal").collect()]


def test_numbering_crosses_pages(spark):
    got = segments(pages(spark, (1, "native", "Introduction\n\nFirst paragraph."), (2, "ocr", "Second paragraph.")))
    assert [g[0] for g in got] == ["seg_00001", "seg_00002", "seg_00003"]
    assert got[2][1:] == (2, "paragraph", "Second paragraph.")


def test_block_classes(spark):
    text = "\n".join([
        "A short introduction to the model.", "", "Γr(Y) = ∑ YijYji. (2)", "",
        "Fig. 1 The uniform distribution over a three-node directed network.", "", "Table 1: ERGM fit for the conflict network.",
    ])
    df = pages(spark, (7, "native", text))
    assert [g[2] for g in segments(df)] == ["paragraph", "equation-marker", "figure-marker", "table-marker"]
    made = S.segment_pages(df)
    markdown = S.translated_markdown(made, made.select("doc_id", "segment_id", "text")).first()["markdown"]
    assert "Figura o gráfica en el original · página 7" in markdown
    assert "Tabla en el original · página 7" in markdown


def test_uncaptioned_visual(spark):
    got = segments(pages(spark, (25, "native", "Somewhat close trend\nVery close trend\nDiagonal", (0, 110))))
    assert got[-1][2:] == ("figure-marker", K.VISUAL_TEXT)
    assert len(segments(pages(spark, (25, "native", "Figure 1. Caption", (5, 110))))) == 1


def test_caption_takes_prose_until_blank(spark):
    text = "Body one\ngoes on\nFigure 2. A caption\nwith more\n\nBody two\n" + K.FOOTNOTE_BOUNDARY + "\nnote"
    blocks = S.with_blocks(pages(spark, (1, "native", text))).first()["blocks"]
    assert blocks == ["Body one goes on", "Figure 2. A caption with more", "Body two", K.FOOTNOTE_BOUNDARY, "note"]


def test_confirmed_footnotes(spark):
    text = "\n".join(["The body cites several sources.", "", K.FOOTNOTE_BOUNDARY, "",
                      "3. First Author: Cited work, 2016. 4. Second Author: Another work, 2011."])
    df = pages(spark, (4, "native", text))
    got = segments(df)
    assert [g[2] for g in got] == ["paragraph", "footnote", "footnote"]
    assert [g[3] for g in got[1:]] == ["3. First Author: Cited work, 2016.", "4. Second Author: Another work, 2011."]
    made = S.segment_pages(df)
    markdown = S.translated_markdown(made, made.select("doc_id", "segment_id", "text")).first()["markdown"]
    assert markdown.count(K.FOOTNOTE_MARKER) == 1 and markdown.index(K.FOOTNOTE_MARKER) < markdown.index("3. First")
    source = S.source_text(df).first()["text"]
    assert K.FOOTNOTE_MARKER in source and K.FOOTNOTE_BOUNDARY not in source


def test_citation_fallback(spark):
    got = segments(pages(spark, (1, "ocr", "A complete body paragraph.\n\n1. Author: Article title, Journal 12, 2020.")))
    assert got[-1][2] == "footnote"
    got = segments(pages(spark, (1, "ocr", "Instructions\n\n1. First step\n2. Second step")))
    assert "footnote" not in [g[2] for g in got]


def test_markdown_pages_and_headings(spark):
    df = pages(spark, (1, "native", "Introduction\n\nA complete paragraph."), (2, "native", "Second page paragraph."))
    made = S.segment_pages(df)
    words = made.select("doc_id", "segment_id", F.lower("text").alias("text"))
    got = {r.page: r.markdown for r in S.translated_markdown(made, words).collect()}
    assert got[1] == "------------[Página N° 1]------------\n\n## introduction\n\na complete paragraph."
    assert got[2] == "------------[Página N° 2]------------\n\nsecond page paragraph."


def test_route_pages(spark):
    good = "Political institutions shape incentives and constrain strategic behavior across democratic systems. It goes on for long."
    native = spark.createDataFrame([(1, 1, good), (1, 2, "scan"), (1, 3, ""), (1, 4, None)], "doc_id long, page int, text string")
    ocr = spark.createDataFrame([(1, 2, "read text"), (1, 3, "  ")], "doc_id long, page int, text string")
    got = {r.page: (r.method, r.text) for r in S.route_pages(native, ocr).collect()}
    assert got == {1: ("native", good), 2: ("ocr", "read text")}
    assert sorted(r.page for r in S.route_pages(native, None, "never").collect()) == [1, 2]
    with pytest.raises(ValueError, match="policy"):
        S.route_pages(native, None)
    assert sorted(r.page for r in S.pages_to_recognise(native).collect()) == [2, 3, 4]


def greedy(sizes):
    ids, count, size, batch = [], 0, 0, 0
    for n in sizes:
        if count and (count >= 12 or size + n > 3200):
            batch, count, size = batch + 1, 0, 0
        ids.append(batch)
        count, size = count + 1, size + n
    return ids


def test_batches_against_greedy_packing(spark):
    rng = random.Random(5)
    docs = {d: [rng.choice([0, 5, 90, 400, 1399, 3300]) for _ in range(n)] for d, n in enumerate([1, 12, 13, 40, 41, 200, 333])}
    docs[99] = [2000, 1000, 500, 3000, 10]
    rows = [(d, 3 * i + 1, "x" * n) for d, sizes in docs.items() for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, ordinal int, text string")
    for chunk in (12, 13, 16, 64, 4096):
        got = {}
        for r in S.batch_segments(df, chunk=chunk).orderBy("doc_id", "ordinal").collect():
            got.setdefault(r.doc_id, []).append(r.batch_id)
        assert got == {d: greedy(sizes) for d, sizes in docs.items()}


def test_boundaries(spark):
    rows = [(1, 1, 1, "heading"), (1, 2, 1, "footnote"), (1, 3, 1, "footnote"), (1, 4, 2, "footnote"), (1, 5, 2, "paragraph"), (1, 6, None, "paragraph")]
    df = spark.createDataFrame(rows, "doc_id long, ordinal int, page int, block_type string")
    got = [(r.page_boundary, r.footnote_boundary) for r in S.boundaries(df).orderBy("ordinal").collect()]
    assert got == [(1, False), (None, True), (None, False), (2, True), (None, False), (None, False)]


def test_blocks_of_a_page_searched_as_a_whole_are_those_of_its_lines(spark):
    # F9 F12 F13 F14 F15 F18: one pattern over the page where each line was searched before.
    parts = [
        "Figure 1. A", "fig.", "Gráfico x", "Table 2 z", "plotting on", "Equation (3) x", "eq. 12", "$$ a $$", "\\[x + y\\]", "$$a", "a = b + c_1",
        "=", "==", "∑ x_1 = one two three four five six seven eight nine ten eleven", "[[FOOTNOTES]]", "[[FOOTNOTES]] x", "plain words", "com-",
        "pleted", "été", "A­B", "", "  ", "\t", " ", " wide　", "﻿", "x\u0085y", "𝒳 = y_1", "a=b=c " + "long words " * 40,
        "x==" + "y" * 257, "x==" + "y" * 258, "\x1e", "Fig. 3.",
    ]
    ends = ["\n", "\n\n", "\r\n", "\r", " \n", "\n ", "\n \n", "\n\t\n", " ", "", "\n\n\n"]
    draw = random.Random(5)
    pages = [(i, "".join(draw.choice(parts) + draw.choice(ends) for _ in range(draw.randint(0, 9)))) for i in range(3000)]
    found = S.with_blocks(spark.createDataFrame([*pages, (-1, None)], "doc_id long, text string"))
    lines = found.withColumn("_lines", S._lines_with_kind(F.col("text")))
    expected = lines.withColumn("expected", F.array_remove(S._blocks_by_line(F.col("_lines")), ""))
    assert expected.where(~F.col("blocks").eqNullSafe(F.col("expected"))).select("text", "blocks", "expected").take(3) == []
    assert expected.where(F.size("blocks") > 2).count() > 1000


def test_batches_of_gapless_ordinals_need_no_counting(spark):
    rows = [(d, i, "x" * (37 * d * i % 1400)) for d, n in ((1, 230), (2, 1), (3, 65)) for i in range(1, n + 1)]
    made = spark.createDataFrame(rows, "doc_id long, ordinal int, text string")
    got, want = (S.batch_segments(made, chunk=16, gapless=g) for g in (True, False))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == len(rows)
    assert "Window" not in got._jdf.queryExecution().toString()


def test_chunks_are_collected_once_and_texts_are_not_dealt(spark):
    # chunks were collected a second time to be summarised, and the query dealt all texts for their lengths.
    rng = random.Random(7)
    docs = {d: [rng.choice([0, 40, 700, 1399, 3300]) for _ in range(n)] for d, n in ((1, 5), (2, 16), (3, 17), (4, 90), (None, 3))}
    df = spark.createDataFrame([(d, i + 1, "x" * n) for d, sizes in docs.items() for i, n in enumerate(sizes)], "doc_id long, ordinal int, text string")
    df = df.unionByName(spark.createDataFrame([(5, 1, None), (5, 2, "𝒳" * 1600), (5, 3, "a")], df.schema))
    want = {d: greedy(sizes) for d, sizes in docs.items()} | {5: [0, 0, 1]}
    for gapless in (True, False):
        got = {}
        for r in sorted(S.batch_segments(df, chunk=16, gapless=gapless).collect(), key=lambda r: r.ordinal):
            got.setdefault(r.doc_id, []).append(r.batch_id)
        assert {d: b for d, b in got.items() if d} == {d: b for d, b in want.items() if d}
        assert got[None] == want[None]
    plan = S.batch_segments(df, gapless=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1


def test_lengths_of_segments_are_taken_before_they_are_dealt(spark):
    from checks.segment import QUERIES

    plan = QUERIES["batch_segments"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    lines = plan.toString().splitlines()
    above = lines[: next(i for i, line in enumerate(lines) if "Join" in line) + 1]
    assert not any("text#" in line for line in above)


def test_markdown_deals_words_once_and_equals_the_join(spark):
    # words went to their segment and then, with it, to their page.
    rng = random.Random(11)
    kinds = ["heading", "paragraph", "footnote", "figure-marker", "table-marker"]
    rows = [(d, f"seg_{i:05d}", i, 1 + i // 4, rng.choice(kinds)) for d in (1, 2, 3, None) for i in range(1, 40)]
    rows += [(4, "twice", 1, 1, "paragraph"), (4, "twice", 2, 1, "heading"), (4, None, 3, 1, "paragraph"), (5, "alone", 1, 7, "footnote")]
    made = spark.createDataFrame(rows, "doc_id long, segment_id string, ordinal int, page int, block_type string")
    words = [(d, s, f" {d} {s}\u00a0") for d, s, *_ in rows if d is None or d < 4 and rng.random() < 0.8]
    words += [(4, "twice", "a"), (4, "twice", None), (4, None, "never"), (9, "seg_00001", "unknown")]
    told = spark.createDataFrame(words, "doc_id long, segment_id string, text string")
    pieces = [sorted(map(str, S.markdown_pieces(made.where("doc_id < 4 OR doc_id IS NULL"), told, n).collect())) for n in (None, len(rows))]
    assert pieces[0] == pieces[1] and len(pieces[0]) == 4 * 39
    odd = [S.markdown_pieces(made.where("doc_id >= 4"), told, n) for n in (None, len(rows))]
    assert odd[0].count() == odd[1].count() == 6
    small, hot = (S.translated_markdown(made.where("doc_id < 4"), told, hot_rows=h) for h in (100, 10))
    assert sorted(small.collect()) == sorted(hot.collect())
    physical = small._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in physical and "Join" in hot._jdf.queryExecution().sparkPlan().toString()
    planned = small._jdf.queryExecution().executedPlan().toString().rpartition("Initial Plan")[2]
    assert planned.count("Exchange hashpartitioning") == 1
