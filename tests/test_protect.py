import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bitext import constants as K
from bitext import schemas
from bitext.functions import text as T
from bitext.operators import inference as I
from bitext.operators import protect as P
from bitext.operators import protect, segment
from bitext.operators import review as R
from bitext.plans.rows import with_parallelism


def segments(spark, *rows):
    return spark.createDataFrame(
        [(1, f"seg_{i + 1:05d}", i + 1, 4, kind, text) for i, (kind, text) in enumerate(rows)],
        "doc_id long, segment_id string, ordinal int, page int, block_type string, text string",
    )


def texts(df):
    return [r.text for r in df.orderBy("segment_id").collect()]


def test_math_round_trip(spark):
    done = P.protect_math(segments(spark, ("paragraph", "The parameter β changes X_{ij} when p < 0.05.")))
    objects = P.math_objects(done)
    assert [r.source for r in objects.orderBy("math_id").collect()] == ["β", "X_{ij}", "p < 0.05"]
    assert "β" not in texts(done)[0]
    back = done.select("doc_id", "segment_id", F.replace("text", F.lit("The parameter"), F.lit("El parámetro")).alias("text"))
    assert P.math_integrity(done, back).count() == 0
    assert texts(P.restore_math(back, objects)) == ["El parámetro β changes X_{ij} when p < 0.05."]
    assert texts(P.restore_math(back, objects, "markdown")) == ["El parámetro $\\beta$ changes $X_{ij}$ when $p < 0.05$."]
    lost = back.withColumn("text", F.lit("Sin marcadores."))
    assert P.math_integrity(done, lost).count() == 1


def test_equation_is_one_object(spark):
    done = P.protect_math(segments(spark, ("paragraph", "α"), ("equation-marker", "Γr(Y) = ∑ YijYji. (2)")))
    assert texts(done) == ["⟦MATH_INLINE_00001⟧", "⟦MATH_DISPLAY_00002⟧"]
    restored = texts(P.restore_math(done.select("doc_id", "segment_id", "text"), P.math_objects(done), "markdown"))[1]
    assert restored == "\n\n~~~text\nΓr(Y) = ∑ YijYji. (2)\n~~~\n\n"


@pytest.mark.parametrize(
    "value, latex",
    [("$$a$$", "a"), ("\\(b\\)", "b"), ("\\[c\\]", "c"), ("$d$", "d"), ("Ω", "\\Omega"), ("x _ 1", "x_{1}"), ("y^2", "y^{2}"),
     ("p ≤ 0,05", "p \\le  0.05"), ("∑", None)],
)
def test_inferred_latex(spark, value, latex):
    assert spark.createDataFrame([(value,)], "v string").select(P.inferred_latex(F.col("v"))).first()[0] == latex


TEXT = "The estimate is 0.25 (2011), p < 0.05; see https://doi.org/10.1/test."


def test_token_round_trip(spark):
    done = P.protect_tokens(segments(spark, ("paragraph", TEXT + " ⟦MATH_INLINE_00001⟧")))
    tokens = P.stable_tokens(done)
    assert [r.source for r in tokens.orderBy(F.substring("placeholder", -7, 5)).collect()] == ["0.25", "2011", "0.05", "https://doi.org/10.1/test."]
    text = texts(done)[0]
    assert "⟦MATH_INLINE_00001⟧" in text and "[[NUMBER_00001]]" in text
    back = done.select("doc_id", "segment_id", "text")
    assert P.stable_integrity(done, back).count() == 0
    single = back.withColumn("text", F.replace("text", F.lit("[[NUMBER_00001]]"), F.lit("[NUMBER_00001]")))
    assert P.stable_integrity(done, single).count() == 0
    assert texts(P.restore_tokens(single, tokens)) == [TEXT + " ⟦MATH_INLINE_00001⟧"]


def test_lost_tokens_are_noted(spark):
    done = P.protect_tokens(segments(spark, ("paragraph", TEXT)))
    back = done.select("doc_id", "segment_id", F.lit("La estimación es [[NUMBER_00001]].").alias("text"))
    restored = texts(P.restore_tokens(P.annotate_lost(done, back), P.stable_tokens(done)))[0]
    assert restored.count("0.25") == 1 and "2011" in restored and "https://doi.org/10.1/test." in restored
    assert K.LOST_VALUES_NOTE in restored


def test_values_and_completeness(spark):
    source = segments(spark, ("paragraph", "It is 0.25 (2011); see https://doi.org/10.1/test."), ("paragraph", "b"))
    good = spark.createDataFrame([(1, "seg_00001", "Es 0.25 (2011); ver https://doi.org/10.1/test."), (1, "seg_00002", "c")], "doc_id long, segment_id string, text string")
    assert P.value_preservation(source, good).count() == 0
    assert P.translation_completeness(source, good).first()["complete"]
    bad = spark.createDataFrame([(1, "seg_00001", "Es 0.35 (2011)."), (1, "seg_9", " ")], "doc_id long, segment_id string, text string")
    assert P.value_preservation(source, bad).count() == 1
    row = P.translation_completeness(source, bad).first()
    assert (row.missing, row.unexpected, row.blank, row.complete) == (1, 1, 1, False)


def test_review(spark):
    source = segments(spark, ("paragraph", "The coefficient ⟦MATH_INLINE_00001⟧ equals 0.25."))
    one = lambda t: spark.createDataFrame([(1, "seg_00001", t)], "doc_id long, segment_id string, text string")
    base = one("El coeficiente ⟦MATH_INLINE_00001⟧ equivale a 0.25.")
    row = R.select_reviewed(source, base, one("El coeficiente ⟦MATH_INLINE_00001⟧ es igual a 0.25."), "normal").first()
    assert row.review_status == "approved" and row.text.endswith("es igual a 0.25.") and row.base_text.endswith("equivale a 0.25.")
    row = R.select_reviewed(source, base, one("El coeficiente es igual a 0.35."), "strict").first()
    assert row.review_status == "base-retained" and row.text == row.base_text
    assert {K.WARN_MATH, K.WARN_NUMBER} <= set(row.review_warnings)
    assert R.select_reviewed(source, base, one(" "), "normal").first()["review_warnings"] == [K.WARN_MISSING]
    assert R.select_reviewed(source, base, None, "normal").first()["review_status"] == "not-reviewed"


def items(n):
    return [{"segmentId": f"seg_{i:05d}", "text": f"Source {i}"} for i in range(1, n + 1)]


def test_recovery_halves_bad_output():
    def call(batch):
        if len(batch) > 1:
            raise ValueError("Did not preserve every segment identifier.")
        return {"segments": batch, "elapsed_ms": 1, "prompt_token_count": 2, "output_token_count": None}

    got = I.call_with_recovery(call, items(3))
    assert [s["segmentId"] for s in got["segments"]] == ["seg_00001", "seg_00002", "seg_00003"]
    assert (got["calls"], got["recoveries"], got["prompt_token_count"], got["output_token_count"]) == (5, 2, 6, None)


def test_recovery_limits():
    waits = []

    def down(batch):
        raise ValueError("The server is not responding: connection refused.")

    got = I.call_with_recovery(down, items(2), pause=waits.append)
    assert got["calls"] == 6 and got["error"] and waits == [0.2, 0.4, 0.6, 0.8, 0.8]
    state = {"left": 2}

    def flaky(batch):
        if state["left"]:
            state["left"] -= 1
            raise ValueError("Ollama rechazó la traducción (HTTP 500).")
        return {"segments": batch}

    assert I.call_with_recovery(flaky, items(2), pause=waits.append)["calls"] == 3
    assert I.call_with_recovery(lambda b: (_ for _ in ()).throw(ValueError("invalid translation JSON")), items(1))["calls"] == 6
    assert I.call_with_recovery(lambda b: (_ for _ in ()).throw(ValueError("disk full")), items(2))["calls"] == 1


def test_identifier_drift_and_dropped_segments(spark):
    kind = "doc_id long, batch_id int, position int, segment_id string, text string"
    asked = spark.createDataFrame([(1, 0, 1, "a", "x"), (1, 0, 2, "b", "y"), (1, 1, 1, "c", "z"), (1, 2, 1, "d", "q"), (1, 2, 2, "e", "r")], kind)
    got = spark.createDataFrame([(1, 0, 1, "b", "Y"), (1, 0, 2, "a", "X"), (1, 1, 1, "zzz", " "), (1, 2, 1, "d", "Q")], kind)
    rows = {r.segment_id: (r.text, r.matched_by, r.error) for r in I.reconcile_outputs(asked, got).collect()}
    assert rows == {"a": ("X", "identifier", None), "b": ("Y", "identifier", None), "c": (" ", "position", "empty"),
                    "d": (None, "none", "count"), "e": (None, "none", "count")}


def test_failures(spark):
    rows = spark.createDataFrame(
        [("translating", "Ollama rechazó la traducción (HTTP 500)."), ("translating", "No conservó los marcadores matemáticos de seg_00001."),
         ("saving", "Access is denied"), ("loading", "x")], "stage string, detail string")
    got = {r.detail: r for r in I.classify_failures(rows).collect()}
    assert got["Ollama rechazó la traducción (HTTP 500)."].code == "MODEL_SERVER_ERROR"
    assert got["No conservó los marcadores matemáticos de seg_00001."].code == "MODEL_OUTPUT_INVALID"
    saved = got["Access is denied"]
    assert saved.recoverable and "guardar el resultado" in saved.message and "original no fue modificado" in saved.message
    assert saved.message.endswith("Detalle: Access is denied") and not got["x"].recoverable


def test_placeholders_past_five_digits(spark):
    # One document with more than 99,999 values.
    rows = [(1, k, f"seg_{k:05d}", " ".join(f"{k}.{j}" for j in range(250)) + " β", "paragraph") for k in range(410)]
    segments = spark.createDataFrame(rows, "doc_id long, ordinal int, segment_id string, text string, block_type string").withColumn("page", F.lit(1))
    safe = P.protect_tokens(P.protect_math(segments))
    last = safe.where("ordinal = 409")
    assert "[[NUMBER_102500]]" in last.first().text
    loose = P.restore_tokens(last.select("doc_id", "segment_id", "text"), P.stable_tokens(last))
    got = P.restore_math(loose, P.math_objects(last)).first().text
    assert got == rows[-1][3]
    six = spark.createDataFrame([(1, "s", "x ⟦MATH_INLINE_123456⟧ y")], "doc_id long, segment_id string, text string")
    objects = spark.createDataFrame([(1, "s", "⟦MATH_INLINE_123456⟧", "β", None, 0.5, "inline")], "doc_id long, segment_id string, placeholder string, source string, latex string, confidence double, type string")
    assert P.restore_math(six, objects).first().text == "x β y"


def test_one_scan_protects_like_one_after_the_other(spark):
    bodies = [
        "Heading of it\n\nThe value is 0.25 (2011) with β in https://x.org/a.\n\nΓr(Y) = ∑ YijYji. (2)",
        "[[NUMBER_00001]] stays, ⟦MATH_INLINE_00007⟧ too; p < 0.05 and $x_1$ = 5 %.\n\nTable 3: Items of 12\n\nprose 7",
        "", "no values at all", "$$a^2$$ 4\n\n1. Smith: Cited work, 2011. 2. Jones: Another work, 2010.",
    ]
    pages = spark.createDataFrame(
        [(d, p, "native", bodies[(d + p) % 5] + (f"\n\nclosing {d} of {p}" if p % 2 else ""), p % 4, 0) for d in (1, 2, 3) for p in range(1, 9)], schemas.PAGES
    )
    segments = segment.segment_pages(pages)
    want = protect.protect_tokens(protect.protect_math(segments))
    columns = ["doc_id", "segment_id", "ordinal", "page", "block_type", "text", "math", "tokens"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(protect.protect_values(segments)) == rows(want)
    paged = protect.protected_pages(pages)
    assert rows(paged) == rows(want) and len(rows(want)) > 40
    assert sorted((r.segment_id, r.doc_id, r.source) for r in paged.collect()) == sorted((r.segment_id, r.doc_id, r.text) for r in segments.collect())


def test_texts_that_hold_the_marks_of_the_search(spark):
    unnumbered = K.MATH_UNNUMBERED
    rows = [
        (1, "a\x1e 12 β\x1f 7 %"), (2, "see https://x.org/β/3 and p < 0.05"), (3, f"{unnumbered} 5 α"), (4, f"https://x.org/{unnumbered} β 6"),
        (5, "[[NUMBER_00001]] ⟦number_00002⟧ 3 a.b@c.org"), (6, None), (7, "ıa@x.org ſ10.1234/abc İ5"),
    ]
    segments = spark.createDataFrame([(1, f"s{k}", k, 1, "paragraph", t) for k, t in rows], "doc_id int, segment_id string, ordinal int, page int, block_type string, text string")
    both = {r.ordinal: r for r in P.protect_values(segments).collect()}
    for r in P.protect_tokens(P.protect_math(segments)).collect():
        assert (both[r.ordinal].text, both[r.ordinal].math, both[r.ordinal].tokens) == (r.text, r.math, r.tokens)
    assert both[1].text == "a\x1e [[NUMBER_00001]] ⟦MATH_INLINE_00001⟧\x1f [[NUMBER_00002]]"
    assert both[3].text == f"{unnumbered} [[NUMBER_00004]] ⟦MATH_INLINE_00004⟧"
    safe = P.protect_values(segments)
    back = P.restore_math(P.restore_tokens(safe.select("doc_id", "segment_id", "text"), P.stable_tokens(safe)), P.math_objects(safe))
    wanted = dict(rows) | {6: None}
    assert {int(r.segment_id[1:]): r.text for r in back.collect() if r.segment_id != "s5"} == {k: t for k, t in wanted.items() if k != 5}


def test_rows_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    pq.write_table(pa.table({"id": list(range(50_000))}), path, compression="none")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024))
    try:
        table = with_parallelism(spark.read.parquet(path), tasks_per_core=4)
        filled = [n for n in table.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(filled) == 50_000 and len(filled) >= spark.sparkContext.defaultParallelism


def test_rows_of_one_row_group_in_many_splits_are_dealt_to_all_cores(spark, tmp_path):
    # As many splits as cores, one of which holds all rows.
    path = str(tmp_path / "one.parquet")
    pq.write_table(pa.table({"id": list(range(50_000))}), path, compression="none")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 * 1024))
    try:
        plain = spark.read.parquet(path)
        assert plain.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        filled = [n for n in with_parallelism(plain).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(filled) == 50_000 and len(filled) >= spark.sparkContext.defaultParallelism


def test_quick_patterns_find_what_the_plain_ones_find(spark):
    # The plain patterns are run as they are, only with white space widened.
    plain = lambda pattern: K.wide_space(pattern, K.SPACES_IN_CLASS)
    assert K.java_pattern(K.MATH) != plain(K.MATH)
    signs = [*"aPr1_^{}$\\()[]<=≤·βΩ₁²⁰×→\n  .,-+%9@:/", "$$", "\\[", "\\]", "p < 0.05", "x _ 1", "10.1234/aB", "http://a.b", "doi: x",
             "ſ", "[[NUMBER_00001]]", "⟦math_inline_00001⟧", "\x1e", "ﬀ", "😀", "a@b.cc", "y^{2}"]
    rng = random.Random(21)
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 14))) for _ in range(20_000)] + ["", None, "no sign at all", "x _", "R　= 4"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", P.math_pieces(F.col("text"), F.lit("paragraph")).alias("math"), P.token_pieces(F.col("text")).alias("tokens"),
        F.regexp_extract_all("text", F.lit(plain(K.MATH)), F.lit(0)).alias("m"), F.regexp_extract_all("text", F.lit(plain(P.TOKEN)), F.lit(0)).alias("t"),
    )
    found = 0
    for r in rows.collect():
        if r.text is None:
            assert r.math is None and r.tokens is None
            continue
        assert r.math[1::2] == r.m and "".join(r.math) == r.text, r.text
        assert r.tokens[1::2] == r.t and "".join(r.tokens) == r.text, r.text
        found += len(r.m) + len(r.t)
    assert found > 20_000


def test_every_piece_of_notation_holds_a_sign(spark):
    # texts without a sign are not searched for notation; no character that begins or is notation may be missing from the signs.
    points = spark.range(1, 0x110000).where("id < 55296 OR id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    forms = points.select(F.explode(F.array("c", F.concat(F.lit("x"), "c"), F.concat(F.lit("p "), "c", F.lit(" 3")), F.concat(F.lit("k "), "c", F.lit("{a}")), F.concat("c", F.lit("a"), "c"))).alias("v"))
    searched = F.size(T.pieces(F.col("v"), K.MATH)) > 1
    found = forms.where(searched).cache()
    assert found.count() > 1000 and found.where(~F.regexp_like("v", F.lit(K.MATH_SIGN))).take(5) == []
    texts = ["no sign, 3 p", "\\(a\\) b", "x_1", "p < 0.05", "p ≈ 3", "p3", "", None, "R² is", "é “quoted” — 7"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = df.select(P.math_pieces(F.col("v"), F.lit("paragraph")), T.pieces(F.col("v"), K.MATH)).collect()
    assert [r[0] for r in got] == [r[1] for r in got] and sum(len(r[0] or []) > 1 for r in got) == 5


def test_texts_without_digits_hold_no_tokens(spark):
    # such texts are not searched, unless a colon or an at sign may name a reference.
    texts = ["plain words", "-+ [[NUMBER_x]]", "a@b.example", "see https://a.example/b", "doi:x", "1", "a1 2", "[[NUMBER_00001]] x", "", None, "٣ x"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r[0] for r in df.select(P.token_pieces(F.col("v"))).collect()]
    want = [r[0] for r in df.select(T.pieces(F.col("v"), P.TOKEN)).collect()]
    assert got == want
