import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitext import constants as K
from bitext import schemas
from bitext.operators import align as A
from bitext.operators import jobs as J
from bitext.operators import layout as L
from bitext.operators import position as P


# ------------------------------------------------------------------- layout
def item(text, x, y, width, height=10.0, index=0):
    return (text, float(x), float(y), float(width), float(height), index)


# Own pages of 500 by 700, each with one property of the layout.
PAGES = {
    "title over columns": (
        [item("Ferries of the delta", 45, 640, 400, 18, 0), item("They leave at dawn", 45, 570, 170, 11, 1), item("and return by noon.", 45, 554, 170, 11, 2),
         item("Winter boats are", 270, 570, 170, 11, 3), item("smaller and slower.", 270, 554, 170, 11, 4)],
        "Ferries of the delta\n\nThey leave at dawn\nand return by noon.\n\nWinter boats are\nsmaller and slower."),
    "shuffled columns": (
        [item("Reeds", 290, 480, 120, 11, 7), item("Mud", 52, 462, 130, 11, 3), item("Tide", 290, 462, 120, 11, 9), item("Sand", 52, 480, 130, 11, 1)],
        "Sand\nMud\n\nReeds\nTide"),
    "drop cap": (
        [item("O", 50, 330, 22, 30, 0), item("ld maps show it", 72, 345, 110, 11, 1), item("as an island", 50, 330, 80, 11, 2)],
        "Old maps show it\nas an island"),
    "split word": ([item("wat", 50, 300, 21, 11, 0), item("er", 71, 300, 14, 11, 1), item("line", 92, 300, 25, 11, 2)], "water line"),
    "raised mark": ([item("harbour", 50, 300, 50, 11, 0), item("3", 101, 306, 4, 6.5, 1), item("opens", 110, 300, 40, 11, 2)], "harbour 3 opens"),
    "notes": (
        [item("The pier was moved", 50, 400, 300, 11, 0), item("twice in ten years.", 50, 384, 300, 11, 1), item("4) Harbour book, page nine.", 50, 95, 300, 8, 2),
         item("Copied by the clerk.", 50, 84, 300, 8, 3)],
        f"The pier was moved\ntwice in ten years.\n\n{K.FOOTNOTE_BOUNDARY}\n\n4) Harbour book, page nine.\nCopied by the clerk."),
    "split label": (
        [item("Oars were shared.", 50, 410, 300, 11, 0), item("17", 50, 88, 9, 8, 1), item(")", 59, 88, 3, 8, 2), item("Harbour book.", 66, 88, 90, 8, 3)],
        f"Oars were shared.\n\n{K.FOOTNOTE_BOUNDARY}\n\n17) Harbour book."),
    "plain footer": ([item("Oars were shared.", 50, 410, 300, 11, 0), item("Delta review", 50, 70, 90, 8, 1)], "Oars were shared.\n\nDelta review"),
}


@pytest.fixture(scope="module")
def read_pages(spark):
    rows = [(1, n, *i) for n, (items, _) in enumerate(PAGES.values()) for i in items] + [(1, 0, " ", 0.0, 0.0, 1.0, 1.0, 99), (1, 1, "nan", float("nan"), 0.0, 1.0, 1.0, 99)]
    space = spark.createDataFrame([(1, n, 500.0, 700.0) for n in range(len(PAGES))], schemas.PAGE_SPACE)
    items = spark.createDataFrame(rows, schemas.TEXT_ITEMS)
    return {list(PAGES)[r.page]: r.text for r in L.reading_order(items, space).collect()}


@pytest.mark.parametrize("name", list(PAGES))
def test_reading_order(read_pages, name):
    assert read_pages[name] == PAGES[name][1]


def test_footnote_top_reads_lines(spark):
    rows = [(1, n, *i) for n, (items, _) in enumerate(PAGES.values()) for i in items]
    space = spark.createDataFrame([(1, n, 500.0, 700.0) for n in range(len(PAGES))], schemas.PAGE_SPACE)
    tops = {list(PAGES)[r.page]: r.footnote_top for r in L.footnote_top(spark.createDataFrame(rows, schemas.TEXT_ITEMS), space).collect()}
    assert {n for n, top in tops.items() if top is not None} == {"notes", "split label"}
    assert abs(tops["split label"] - (88 + 8 + 0.35 * 11)) < 1e-9


def test_gaps(spark):
    ranges = spark.createDataFrame([(1, 0.0, 3.0), (1, 2.0, 5.0), (1, 9.0, 8.0), (1, 11.0, 12.0), (1, 11.0, 12.0)], "k int, start double, end double")
    islands = L.merge_ranges(ranges, ["k"])
    assert [(r.start, r.end, r.gap) for r in islands.orderBy("island").collect()] == [(0.0, 5.0, None), (8.0, 9.0, 3.0), (11.0, 12.0, 2.0)]
    assert L.largest_gap(islands, ["k"], 1.0).first()[1:] == (3.0, 6.5)
    assert L.largest_gap(islands, ["k"], 4.0).count() == 0


# --------------------------------------------------------------- alignments
def reader(spark, source, target, kind="paragraph"):
    return (
        spark.createDataFrame([(1, "seg_00001", 1, 1, kind, source, "native")], schemas.SEGMENTS),
        spark.createDataFrame([(1, "seg_00001", 1, target, None, None, "needs-review", ["w"])], schemas.TRANSLATIONS),
        spark.createDataFrame([(1, "al_seg_00001", 1, ["seg_00001"], ["seg_00001"], "1:1", "generated-id", None)], schemas.ALIGNMENTS),
    )


SOURCE = [
    "Rivers that cross several districts are measured by each of them in turn, with gauges of different age.",
    "The oldest gauge stands below the mill and has been read every morning since the bridge was rebuilt.",
    "Its readings were copied by hand into ledgers until the winter in which the archive moved to the new town hall.",
]
TARGET = [
    "Los ríos que cruzan varios distritos son medidos por cada uno de ellos, con instrumentos de distinta edad.",
    "El instrumento más antiguo está debajo del molino y se lee cada mañana desde que se rehízo el puente.",
    "Sus lecturas se copiaron a mano en libros hasta el invierno en que el archivo pasó al nuevo ayuntamiento.",
]


def test_resegment_one_to_one(spark):
    before = reader(spark, " ".join(SOURCE), " ".join(TARGET))
    source, target, aligned = A.resegment(*before)
    assert [r.text for r in source.orderBy("ordinal").collect()] == SOURCE
    assert [r.text for r in target.orderBy("ordinal").collect()] == TARGET
    assert {r.review_status for r in target.collect()} == {"needs-review"}
    assert [r.type for r in aligned.collect()] == ["1:1"] * 3 and {r.confidence for r in aligned.collect()} == {0.82}
    assert source.first()["parent_segment_id"] == "seg_00001"
    report = A.resegment_report(before, (source, target, aligned)).first()
    assert (report.source_segments, report.alignments, report.subdivided_alignments, report.paragraph_fallbacks) == (3, 3, 1, 0)


def test_cuts_of_a_long_alignment(spark):
    # Twenty thousand units of one length in three thousand groups: cuts are the rounded multiples of their share.
    df = spark.range(1).select(F.array_repeat(F.lit(7), 20_000).alias("ls"), F.lit(3000).alias("k"))
    got = df.select(A.cut_ends(F.col("ls"), F.col("k")).alias("e")).first().e
    share = 20_000 / 3000
    assert len(got) == 2999 and all(abs(e - share * (j + 1)) <= 0.5 + 1e-9 for j, e in enumerate(got))
    odd = spark.createDataFrame([([], None), ([3], 1), (None, 2), ([1, 1, 1], 3), ([0, 0, 9], 2)], "ls array<int>, k int")
    assert [r.e for r in odd.select(A.cut_ends(F.col("ls"), F.col("k")).alias("e")).collect()] == [None, [], None, [1, 2], [2]]


def test_resegment_uneven(spark):
    source, target, aligned = A.resegment(*reader(spark, " ".join(SOURCE), " ".join(TARGET[:2])))
    rows = aligned.orderBy("part").collect()
    assert len(rows) == 2 and "n:1" in [r.type for r in rows] and {r.confidence for r in rows} == {0.62}
    used = [i for r in rows for i in r.source_segment_ids]
    assert sorted(used) == sorted(r.segment_id for r in source.collect()) and len(used) == 3


def test_resegment_leaves_markers(spark):
    source, target, aligned = A.resegment(*reader(spark, " ".join(SOURCE), " ".join(TARGET), "figure-marker"))
    assert source.count() == target.count() == aligned.count() == 1
    assert aligned.first()["alignment_id"] == "al_seg_00001" and aligned.first()["groups"] is None


def stepwise(lengths, k):
    prefix = [0]
    for n in lengths:
        prefix.append(prefix[-1] + max(1, n))
    ends, start = [], 0
    for g in range(1, k):
        options = range(start + 1, len(lengths) - (k - g) + 1)
        start = min(options, key=lambda e: (abs(prefix[e] - prefix[-1] * g / k), e))
        ends.append(start)
    return ends


def test_cuts_against_stepwise_choice(spark):
    rng = random.Random(6)
    rows = [([rng.choice([0, 1, 50, 90, 101, 400, 2000]) for _ in range(n)], k) for n in range(1, 16) for k in range(1, n + 1)]
    df = spark.createDataFrame([(i, ls, k) for i, (ls, k) in enumerate(rows)], "i int, ls array<int>, k int")
    got = {r.i: r.e for r in df.select("i", A.cut_ends(F.col("ls"), F.col("k")).alias("e")).collect()}
    assert got == {i: stepwise(ls, k) for i, (ls, k) in enumerate(rows)}


PAIRS = [("a1", 1, ["s1"], ["t1", "t2"]), ("a2", 2, ["s2", "s3"], ["t3"])]


def aligned_pairs(spark, pairs=PAIRS):
    return spark.createDataFrame([(1, i, o, s, t, "", "fixture", None) for i, o, s, t in pairs], schemas.ALIGNMENTS)


@pytest.mark.parametrize(
    "side, ids, target, want",
    [("source", ["s1"], "translation", ["t1", "t2"]), ("translation", ["t3"], "source", ["s2", "s3"]), ("source", ["s1"], "source", []),
     ("translation", ["missing"], "source", [])],
)
def test_projection(spark, side, ids, target, want):
    picked = spark.createDataFrame([(1, 7, side, ids)], "doc_id long, selection_id long, side string, segment_ids array<string>")
    rows = A.project_selection(picked, aligned_pairs(spark), target).orderBy("alignment_ordinal", "place").collect()
    assert [r.segment_id for r in rows] == want


# ---------------------------------------------------------------- positions
def bounds(spark, rows):
    return spark.createDataFrame([(1, side, i, float(a), float(b)) for side, i, a, b in rows], schemas.BOUNDS)


GOLDEN = [("source", "s1", 100, 200), ("source", "s2", 300, 400), ("translation", "t1", 50, 150), ("translation", "t2", 250, 350), ("translation", "t3", 350, 500)]


def mapped(spark, leader, *positions):
    alignments = aligned_pairs(spark, [("a1", 1, ["s1"], ["t1"]), ("a2", 2, ["s2"], ["t2", "t3"])])
    events = spark.createDataFrame([(1, i, float(p)) for i, p in enumerate(positions)], "doc_id long, i int, position double")
    intervals = P.alignment_intervals(alignments, bounds(spark, GOLDEN), leader)
    return [r.mapped for r in P.map_positions(events, intervals).orderBy("i").collect()]


def test_positions(spark):
    assert mapped(spark, "source", 350, 250, 0, 100, 999) == [375.0, 200.0, 50.0, 50.0, 500.0]
    assert mapped(spark, "translation", 375) == [350.0]


def scan(intervals, p):
    rows = sorted(intervals, key=lambda r: (r[1], r[2], r[0]))

    def between(v, a, b, c, d):
        return (c + d) / 2 if b <= a else c + min(1.0, max(0.0, (v - a) / (b - a))) * (d - c)

    if not rows:
        return None
    if p <= rows[0][1]:
        return rows[0][3]
    for n, (_, s, e, fs, fe) in enumerate(rows):
        if p <= e:
            return between(p, s, e, fs, fe)
        if n + 1 < len(rows) and p < rows[n + 1][1]:
            return between(p, e, rows[n + 1][1], fe, rows[n + 1][3])
    return rows[-1][4]


def test_positions_against_a_scan(spark):
    rng = random.Random(8)
    docs = {}
    for d in range(40):
        rows = []
        for o in range(rng.randint(1, 12)):
            a, f = rng.randint(0, 60), rng.randint(0, 60)
            rows.append((o, float(a), float(a + rng.choice([0, 0, 3, 10, 40])), float(f), float(f + rng.choice([0, 5, 20]))))
        docs[d] = rows
    intervals = spark.createDataFrame(
        [(d, f"a{o}", o, *rest) for d, rows in docs.items() for o, *rest in rows],
        "doc_id long, alignment_id string, alignment_ordinal int, leader_start double, leader_end double, follower_start double, follower_end double")
    events = spark.createDataFrame([(d, p / 2) for d in [*docs, 777] for p in range(-4, 230)], "doc_id long, position double")
    for hot in (10**6, 3):
        got = {(r.doc_id, r.position): r.mapped for r in P.map_positions(events, intervals, hot_rows=hot).collect()}
        assert len(got) == events.count()
        for (d, p), value in got.items():
            assert value == scan(docs.get(d, []), p), (d, p, docs.get(d))


def test_scroll_top(spark):
    one = spark.range(1).select(P.follower_scroll_top(F.lit(500.0), F.lit(400.0), F.lit(1200.0)))
    assert one.first()[0] == 360.0


def test_visible_page(spark):
    pages = spark.createDataFrame([(1, 1, 0.0, 800.0), (1, 2, 824.0, 800.0), (1, 3, 1648.0, 800.0)], "doc_id long, page_number int, top double, height double")
    views = spark.createDataFrame([(1, 1, 650.0, 600.0), (1, 2, 1024.0, 500.0), (1, 3, 3000.0, 500.0), (1, 4, 10.0, 0.0)], "doc_id long, event_id int, top double, height double")
    got = {r.event_id: (r.page_number, r.page_offset) for r in P.locate_visible_page(views, pages).collect()}
    assert got == {1: (2, 0.0), 2: (2, 0.25)}


def test_monotone(spark):
    order = spark.createDataFrame([(1, "s1", 1), (1, "s2", 2)], "doc_id long, segment_id string, ordinal int")
    alignments = aligned_pairs(spark, [("a1", 1, ["s1"], ["t1"]), ("a2", 2, ["s2"], ["t2"])])
    assert P.monotonicity(alignments, bounds(spark, GOLDEN), order).first()["monotone"]
    swapped = aligned_pairs(spark, [("a1", 1, ["s1"], ["t3"]), ("a2", 2, ["s2"], ["t1"])])
    assert not P.monotonicity(swapped, bounds(spark, GOLDEN), order).first()["monotone"]


# --------------------------------------------------------------------- jobs
def job_rows(*rows):
    return [("p", d, i, None, kind, ("translating", n, 10, "") if n else None, error) for i, (d, kind, n, error) in enumerate(rows)]


def test_job_state(spark):
    rows = job_rows(("a", "started", None, None), ("a", "progressed", 3, None), ("b", "started", None, None), ("b", "finished", None, None),
                    ("c", "failed", None, "No se pudo traducir."), ("c", "progressed", 5, None), ("d", "progressed", 1, None),
                    ("e", "started", None, None), ("e", "progressed", 2, None), ("e", "started", None, None))
    got = {r.document_id: (r.phase, r.progress and r.progress.current, r.error) for r in J.job_state(spark.createDataFrame(rows, schemas.JOB_EVENTS)).collect()}
    assert got == {"a": ("running", 3, None), "c": ("failed", None, "No se pudo traducir."), "e": ("running", None, None)}


def test_debounce(spark):
    rng = random.Random(9)
    rows, at = [], 0
    for i in range(600):
        at += rng.choice([0, 20, 100, 200, 800])
        rows.append((i % 3 // 2, i, at, None, rng.choice(["scroll"] * 5 + ["intent"]), rng.choice(["source", "translation"]), rng.choice(["auto", "smooth"])))
    want = []
    for reader_id in (0, 1):
        quiet = None
        for r in (r for r in rows if r[0] == reader_id):
            quiet, accepted = J.scroll_step(quiet, r[4], r[5], r[2], r[6])
            want += [r[1]] if accepted else []
    df = spark.createDataFrame(rows, schemas.SCROLL_EVENTS)
    for hot in (10**6, 50):
        assert sorted(r.seq for r in J.debounced_sync(df, hot).collect()) == sorted(want)


def test_scroll_without_move_silences_nobody(spark):
    kind = "reader_id long, seq long, at_ms long, kind string, side string, behavior string, moved boolean"
    rows = [(1, 0, 0, "scroll", "source", "smooth", False), (1, 1, 50, "scroll", "translation", "auto", True), (1, 2, 60, "scroll", "source", "auto", True), (1, 3, 70, "scroll", "translation", "auto", None)]
    got = sorted(r.seq for r in J.debounced_sync(spark.createDataFrame(rows, kind)).collect())
    assert got == [0, 1, 3]


def page_of(items, width=600.0, height=800.0):
    columns = {c: np.array(v, dtype=object if c == "text" else float) for c, v in items.items()}
    columns["source_index"] = np.arange(len(items["x"]))
    columns["page_width"], columns["page_height"] = np.full(len(items["x"]), width), np.full(len(items["x"]), height)
    return L._Page(columns)


def printed(rng, n, height=800.0):
    """Words on lines with slant, raised marks, large titles and drop caps."""
    items = {"text": [], "x": [], "y": [], "width": [], "height": []}
    for _ in range(n):
        line = rng.randint(0, max(1, n // 12)) * 12.0
        tall = rng.choice([10.0, 10.0, 10.0, 10.5, 6.0, 14.0, 30.0])
        items["text"].append(rng.choice(["word", "of", "1", "x,"]))
        items["x"].append(rng.uniform(0, 560))
        items["y"].append(line + rng.choice([0, 0, 0, 0.4, -0.6, 4.0]))
        items["width"].append(rng.uniform(4, 40))
        items["height"].append(tall)
    return page_of(items, height=height)


@pytest.mark.parametrize("seed", range(8))
def test_lines_of_the_sweep_are_those_of_all_lines(monkeypatch, seed):
    page = printed(random.Random(seed), 600, 6000.0)
    ids = np.arange(len(page.text))
    monkeypatch.setattr(L, "SWEEP", 1)
    swept = L._gather_lines(page, ids)
    monkeypatch.setattr(L, "SWEEP", 10**9)  # no line is ever left behind
    assert [(x["items"], x["base"]) for x in swept] == [(x["items"], x["base"]) for x in L._gather_lines(page, ids)]


def test_a_page_of_fifty_thousand_items():
    page = printed(random.Random(1), 50_000, 60_000.0)
    begun = time.perf_counter()
    lines = L._gather_lines(page, np.arange(50_000))
    assert sorted(i for x in lines for i in x["items"]) == list(range(50_000)) and time.perf_counter() - begun < 60


def test_texts_are_cut_into_items_by_a_plain_dot(spark, tmp_path):
    from checks import reader

    texts = ["x" * 60, "y" * 61, "a\nb\r c\x85" * 40, "é😀" * 90, " ", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = reader.text_items(spark, str(tmp_path))
    assert "[\\s\\S]" not in items._jdf.queryExecution().toString()
    got = {(r.doc_id, r.source_index): (r.text, r.width) for r in items.collect()}
    want = {}
    for doc, text in enumerate(texts):
        flat = (text or "").replace("\n", " ")
        for i in range(0, len(flat), 60):
            part = flat[i : i + 60]
            want[doc, i // 60] = ("1. " * (i // 60 % 40 == 36) + part, len(part) * 4.0)
    assert got == want


def test_lines_out_of_reach_are_left_soon(monkeypatch):
    # A column of a thousand lines of one item each: an item is held against the few lines around it.
    compared = []
    monkeypatch.setattr(L, "abs", lambda x: compared.append(x) or abs(x), raising=False)
    n = 1000
    page = L._Page({
        "text": np.array(["t"] * n), "x": np.zeros(n), "y": np.arange(n, 0, -1) * 18.0, "width": np.full(n, 9.0), "height": np.full(n, 10.0),
        "source_index": np.arange(n), "page_width": np.array([600.0]), "page_height": np.array([800.0]),
    })
    assert L._render(page, np.arange(n)) == "\n".join(["t"] * n)
    assert len(compared) < 10 * n
