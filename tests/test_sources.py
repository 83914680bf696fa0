import glob
import hashlib
import json

from pyspark.sql import functions as F

from bitext import schemas
from bitext.plans.processing import process
from bitext.sources import artifacts as S
from bitext.sources import files as FS
from checks import sources as checked
from bitext.streaming.catalog import incremental_reconcile
from bitext.streaming.jobs import stream_job_state


def test_scan(spark, tmp_path):
    folder = tmp_path / "C_trad" / "Set 1"
    folder.mkdir(parents=True)
    (folder / "Doc.ES.MD").write_bytes(b"hola")
    (folder / "skip.doc").write_bytes(b"x")
    (tmp_path / "C_trad" / "b.txt").write_bytes(b"texto")
    rows = {r.relative_path: r for r in FS.scan_files(spark, str(tmp_path), "C_trad", "translation", "p").collect()}
    assert set(rows) == {"C_trad/Set 1/Doc.ES.MD", "C_trad/b.txt"}
    doc = rows["C_trad/Set 1/Doc.ES.MD"]
    assert (doc.sha256, doc.size, doc.media_type) == (hashlib.sha256(b"hola").hexdigest(), 4, "text/markdown")
    texts = {r.text for r in FS.read_translation_texts(spark, str(tmp_path), "C_trad").collect()}
    assert texts == {"hola", "texto"}


def test_scan_finds_hidden_names_and_no_links(spark, tmp_path):
    base = tmp_path / "C_orig"
    for name in ("a.pdf", "_draft.PDF", ".h.pdf", "_sub/b.pdf", ".deep/x/y/z.pdf", "sub/c d.pdf", "skip.txt", "pdf"):
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(name.encode() * 300_000)
    (base / "link.pdf").symlink_to(base / "a.pdf")
    (base / "loop").symlink_to(base)
    rows = {r.relative_path: r for r in FS.scan_files(spark, f"file://{tmp_path}", "C_orig", "original", "p").collect()}
    want = ["a.pdf", "_draft.PDF", ".h.pdf", "_sub/b.pdf", ".deep/x/y/z.pdf", "sub/c d.pdf"]
    assert set(rows) == {f"C_orig/{n}" for n in want}
    for n in want:
        r = rows[f"C_orig/{n}"]
        assert r.sha256 == hashlib.sha256(n.encode() * 300_000).hexdigest() and r.size == len(n) * 300_000
        assert r.modified_at == int((base / n).stat().st_mtime) and r.media_type == "application/pdf"


def test_manifests(spark, tmp_path):
    def project(path, **changes):
        config = {"projectId": path, "name": path.title(), "schemaVersion": 1, "originalDir": "A_orig", "translationDir": "A_trad", **changes}
        state = tmp_path / path / "state"
        state.mkdir(parents=True)
        (state / "project.json").write_text(json.dumps(config))

    project("beta")
    project("alpha")
    project("old", schemaVersion=2)
    project("blank", name=" ")
    project("nested", originalDir="a/b")
    project("build")
    broken = tmp_path / "broken" / "state"
    broken.mkdir(parents=True)
    (broken / "project.json").write_text("{nope")
    found = FS.load_project_manifests(spark, f"{tmp_path}/*/state/project.json", str(tmp_path)).collect()
    assert [r.name for r in found] == ["Alpha", "Beta"]
    assert found[0].root == f"{tmp_path}/alpha" and found[0].original_dir == "A_orig"


def test_catalog_files(spark, tmp_path):
    path = tmp_path / "documents.json"
    assert FS.read_catalog_file(spark, str(path), "p").count() == 0
    file = {"relativePath": "C_orig/a.pdf", "sha256": "a", "size": 1, "modifiedAt": 2, "mediaType": "application/pdf"}
    path.write_text(json.dumps({"schemaVersion": 1, "documents": [{"documentId": "d1", "original": file, "translation": None}, {"documentId": "d2", "translation": file, "hidden": True}]}))
    rows = FS.read_catalog_file(spark, str(path), "p")
    got = {r.document_id: (r.ordinal, r.hidden, r.original and r.original.relative_path) for r in rows.collect()}
    assert got == {"d1": (0, False, "C_orig/a.pdf"), "d2": (1, True, None)}
    store = str(tmp_path / "store")
    assert S.read_catalog(spark, store).count() == 0
    S.write_catalog(rows, store)
    assert sorted(map(str, S.read_catalog(spark, store).select(rows.columns).collect())) == sorted(map(str, rows.collect()))


def test_artifacts_replace_documents(spark, tmp_path):
    path = str(tmp_path)
    rows = lambda docs, text: spark.createDataFrame([(d, 1, text) for d in docs], "doc_id long, ordinal int, text string")
    S.write_artifacts({"segments": rows(range(20), "old"), "translations": rows(range(20), "old")}, path, buckets=4)
    assert S.read_reader_artifacts(spark, path) == {}
    S.write_artifacts({"segments": rows([3, 50], "new"), "alignments": rows([3, 4, 50], "new")}, path, buckets=4)
    segments = {r.doc_id: r.text for r in S.read_table(spark, f"{path}/segments").collect()}
    # Document 4 was written too, without segments: its old ones are gone.
    assert segments == {**{d: "old" for d in range(20) if d != 4}, 3: "new", 50: "new"}
    complete = S.read_reader_artifacts(spark, path)
    assert {r.doc_id for r in complete["translations"].collect()} == {3}


def test_artifacts_leave_no_old_rows(spark, tmp_path):
    path = str(tmp_path)
    rows = lambda docs: spark.createDataFrame([(d, 1, "x") for d in docs], "doc_id long, ordinal int, text string")
    S.write_artifacts({"segments": rows(range(9)), "math_objects": rows(range(9))}, path, buckets=4)
    # Document 3 no longer has math, document 4 nothing at all.
    S.write_artifacts({"segments": rows([3]), "math_objects": rows([])}, path, 4, spark.createDataFrame([(3,), (4,)], "doc_id long"))

    def left(name):
        found = S.read_table(spark, f"{path}/{name}")
        return set() if found is None else {r.doc_id for r in found.collect()}

    assert left("segments") == set(range(9)) - {4} and left("math_objects") == set(range(9)) - {3, 4}
    S.write_artifacts({"segments": rows(range(9)), "math_objects": rows([])}, path, buckets=4)
    assert left("segments") == set(range(9)) and left("math_objects") == set()


def test_pages_as_text(spark, tmp_path):
    pages = spark.createDataFrame([(1, p, f"page {p}") for p in range(1, 6)], "doc_id long, page int, text string")
    S.write_pages_as_text(pages, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "doc_id=1").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split() == [w for p in range(1, 6) for w in ("page", str(p))]


def test_end_to_end(spark):
    text = "Heading of it\n\nThe value is 0.25 (2011) with β in https://x.org/a.\n\nΓr(Y) = ∑ YijYji. (2)"
    pages = spark.createDataFrame([(d, p, "native", text, 0, 0) for d in (1, 2) for p in (1, 2)], schemas.PAGES)

    def make():
        return lambda batch: {"segments": [{"segmentId": s["segmentId"], "text": "ES " + s["text"]} for s in batch]}

    out = process(pages, make, lambda base: base.withColumn("text", F.concat("text", F.lit(" ok"))), "normal")
    rows = [r.text for r in out["translations"].where("doc_id = 2").orderBy("ordinal").collect()]
    assert rows[0] == "ES Heading of it ok" and rows[1] == "ES The value is 0.25 (2011) with β in https://x.org/a. ok"
    assert len(rows) == 6 and out["failures"].count() == 0
    markdown = out["markdown"].where("doc_id = 1 AND page = 1").first()["markdown"]
    assert "## ES Heading of it ok" in markdown and "$\\beta$" in markdown and "~~~text" in markdown
    meta = out["metadata"].where("doc_id = 1").first()
    assert (meta.native_page_count, meta.reviewed_segment_count, meta.math_object_count) == (2, 6, 4)


def test_no_incomplete_document_leaves(spark):
    def lazy_model():
        """Leaves one segment of document 2 out, blanks one of 3, breaks the math of 4, and renames all of 5."""

        def call(batch):
            doc = batch[0]["text"].split()[1]
            out = [{"segmentId": s["segmentId"], "text": "ES " + s["text"]} for s in batch]
            if doc == "two":
                out = out[:-1]
            if doc == "three":
                out[-1]["text"] = " \n"
            if doc == "four":
                out = [{**s, "text": s["text"].replace("⟦", "<")} for s in out]
            if doc == "five":
                out = [{**s, "segmentId": f"x{k}"} for k, s in enumerate(out)]
            return {"segments": out}

        return call

    names = {1: "one", 2: "two", 3: "three", 4: "four", 5: "five"}
    pages = spark.createDataFrame(
        [(d, 1, "native", f"Heading {n} of it with β in it\n\nBody {n} of it with γ in it.", 0, 0) for d, n in names.items()], schemas.PAGES
    )
    out = process(pages, lazy_model)
    ids = lambda t: {r.doc_id for r in out[t].select("doc_id").distinct().collect()}
    for table in ("segments", "translations", "math_objects", "alignments", "metadata", "source_text", "markdown"):
        assert ids(table) == {1, 5}, table
    assert ids("failures") == {2, 3, 4}
    assert [r.text[:8] for r in out["translations"].where("doc_id = 5").orderBy("ordinal").collect()] == ["ES Headi", "ES Body "]


def test_failed_review_keeps_the_base(spark):
    pages = spark.createDataFrame([(d, 1, "native", f"Heading {d} of it\n\nThe value {d} is 0.25 here.", 0, 0) for d in (1, 2)], schemas.PAGES)

    def translator():
        return lambda batch: {"segments": [{"segmentId": s["segmentId"], "text": "ES " + s["text"]} for s in batch]}

    def reviewer():
        def call(batch):
            drop = spoil and "NUMBER_00001" in batch[0]["sourceText"]
            return {"segments": [{"segmentId": s["segmentId"], "text": s["baseText"].replace("NUMBER", "N") if drop else s["baseText"] + " ok"} for s in batch]}

        return call

    for spoil, end in ((False, " ok"), (True, "it")):
        out = process(pages, translator, review_level="normal", make_reviewer=reviewer)
        first = out["translations"].where("doc_id = 1").orderBy("ordinal").first()
        assert first.text.endswith(end), first
        assert out["failures"].count() == 0


def test_job_stream_over_several_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [("p", d, i, f"2024-01-01 00:00:{i:02d}", k, None, e) for i, (d, k, e) in enumerate(
        [("a", "started", None), ("b", "started", None), ("a", "failed", "x"), ("b", "finished", None), ("a", "started", None), ("c", "progressed", None)])]
    for n in range(3):
        part = spark.createDataFrame(rows[2 * n:2 * n + 2], schemas.JOB_EVENTS.replace("ts timestamp", "ts string"))
        part.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schemas.JOB_EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    query = (stream_job_state(stream).writeStream.format("memory").queryName("jobs_out").outputMode("update")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    out = spark.table("jobs_out").groupBy("document_id").agg(F.max_by("phase", "seq").alias("phase"))
    assert {r.document_id: r.phase for r in out.collect()} == {"a": "running", "b": "finished"}


def test_late_event_does_not_revive_a_finished_job(spark, tmp_path):
    source = str(tmp_path / "in")
    batches = [[("a", 0, "started"), ("b", 5, "started")], [("a", 3, "finished")], [("a", 1, "started"), ("a", 2, "progressed")], [("b", 7, "failed")]]
    for n, rows in enumerate(batches):
        part = spark.createDataFrame([("p", d, i, f"2024-01-01 00:00:{i:02d}", k, None, None) for d, i, k in rows], schemas.JOB_EVENTS.replace("ts timestamp", "ts string"))
        part.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schemas.JOB_EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
    query = (stream_job_state(stream).writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).outputMode("update")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.phase for r in rows if r.document_id == "a" and r.seq >= 3} == {"finished"}
    last = {}
    for r in sorted(rows, key=lambda r: r.seq):
        last[r.document_id] = r.phase
    assert last == {"a": "finished", "b": "failed"}
    assert not [r for r in rows if r.document_id == "a" and r.phase == "running" and r.seq != 0]


def test_incremental_reconcile(spark, tmp_path):
    listing, store = str(tmp_path / "in"), str(tmp_path / "catalog")
    projects = spark.createDataFrame([("p", "C_orig", "C_trad")], schemas.PROJECTS)

    def arrive(*rows):
        spark.createDataFrame([("p", *r, 1, 1, "x") for r in rows], schemas.FILES).coalesce(1).write.mode("append").parquet(listing)
        stream = spark.readStream.schema(schemas.FILES).parquet(listing)
        query = incremental_reconcile(stream, projects, store).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return {r.document_id: r for r in S.read_catalog(spark, store).collect()}

    first = arrive(("original", "C_orig/a.pdf", "h1"))
    second = arrive(("original", "C_orig/moved/a.pdf", "h1"), ("translation", "C_trad/moved/a.md", "h2"))
    assert list(first) == list(second)
    record = next(iter(second.values()))
    assert (record.original.relative_path, record.translation.relative_path) == ("C_orig/moved/a.pdf", "C_trad/moved/a.md")


def test_a_scan_of_the_incremental_query_is_written_by_several_tasks(spark, monkeypatch):
    made = []
    monkeypatch.setattr(checked, "new_folder", lambda spark, name, make=checked.new_folder: made.append((name, make(spark, name))) or made[-1][1])
    got = checked.QUERIES["incremental_reconcile"](spark, "/root/testdata/sf0.001")
    assert {r.versions for r in got.select("versions").distinct().collect()} == {2}
    inboxes = [path for name, path in made if name == "listings"]
    assert all(len(glob.glob(path.removeprefix("file:") + "/*.parquet")) >= 2 * spark.sparkContext.defaultParallelism for path in inboxes)
