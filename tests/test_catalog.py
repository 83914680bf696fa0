from pyspark.sql import functions as F

from bitext import schemas
from bitext.operators import catalog as C
from bitext.operators import library as L


def file(side, path, sha, size=1):
    return ("p", side, path, sha, size, 5, "x")


def ref(path, sha, size=1):
    return None if path is None else (path, sha, size, 1, "x")


def tables(spark, catalog, files):
    return (
        spark.createDataFrame(catalog, schemas.CATALOG),
        spark.createDataFrame(files, schemas.FILES),
        spark.createDataFrame([("p", "C_orig", "C_trad")], schemas.PROJECTS),
    )


def states(spark, catalog, files, hot_rows=10**6):
    c, f, p = tables(spark, catalog, files)
    records = C.reconcile(c, f, p, hot_rows=hot_rows)
    return {r.document_id: r for r in C.summaries(records, p).collect()}


def test_new_pair_and_single_side(spark):
    got = states(spark, [], [file("original", "C_orig/article.pdf", "a"), file("translation", "C_trad/article.md", "b"), file("original", "C_orig/alone.pdf", "c")])
    assert sorted((r.title, r.pair_state) for r in got.values()) == [("alone", "missing-translation"), ("article", "paired")]


def test_moved_file_keeps_its_record(spark):
    catalog = [("p", "d1", 0, ref("C_orig/article.pdf", "a"), ref("C_trad/article.md", "b"), False)]
    got = states(spark, catalog, [file("original", "C_orig/new/renamed.pdf", "a"), file("translation", "C_trad/article.md", "b")])
    assert got["d1"].pair_state == "manually-linked" and got["d1"].original.relative_path == "C_orig/new/renamed.pdf"


def test_removed_file_is_unavailable(spark):
    got = states(spark, [("p", "d1", 0, ref("C_orig/gone.pdf", "a"), None, False)], [])
    assert got["d1"].pair_state == "unavailable" and got["d1"].original.relative_path == "C_orig/gone.pdf"


def test_conflict(spark):
    files = [file("original", "C_orig/paper.pdf", "a"), file("translation", "C_trad/paper.md", "b"), file("translation", "C_trad/paper.pdf", "c")]
    got = states(spark, [], files)
    assert [r.pair_state for r in got.values()] == ["conflict", "conflict"]


def test_adoption_and_exact_paths_first(spark):
    catalog = [
        ("p", "d1", 0, ref("C_orig/a.pdf", "h1"), None, False),
        ("p", "d2", 1, ref("C_orig/lost.pdf", "same"), None, False),
        ("p", "d3", 2, ref("C_orig/kept.pdf", "same"), None, False),
        ("p", "d4", 3, None, None, False),
    ]
    files = [file("original", "C_orig/a.pdf", "h1"), file("original", "C_orig/kept.pdf", "same"), file("translation", "C_trad/A.es.md", "t")]
    got = states(spark, catalog, files)
    assert got["d1"].translation.relative_path == "C_trad/A.es.md" and got["d1"].pair_state == "paired"
    assert got["d2"].pair_state == "unavailable" and got["d3"].pair_state == "missing-translation"
    assert got["d4"].pair_state == "unavailable" and got["d4"].title == "Untitled document"


def test_hot_groups_of_copies(spark):
    catalog = [("p", f"d{i:02d}", i, ref(f"C_orig/old/{i:02d}.pdf", "same"), None, False) for i in range(40)]
    files = [file("original", f"C_orig/new/{i:02d}.pdf", "same") for i in range(30)]
    files += [file("translation", f"C_trad/x{i}/doc.md", f"t{i}") for i in range(5)]
    plain, cut_up = (
        {d: (r.pair_state, r.original) for d, r in states(spark, catalog, files, hot).items()} for hot in (10**6, 4)
    )
    assert plain == cut_up
    assert plain["d00"][1].relative_path == "C_orig/new/00.pdf" and plain["d29"][1].relative_path == "C_orig/new/29.pdf"
    assert plain["d30"][0] == "unavailable"


def test_actions(spark):
    catalog = [("p", f"d{i}", i, ref("C_orig/a.pdf", "a"), ref("C_trad/a.md", "b"), False) for i in range(6)]
    c, _, _ = tables(spark, catalog, [])
    actions = spark.createDataFrame(
        [("p", "d0", 1, "hide"), ("p", "d1", 1, "hide"), ("p", "d1", 2, "restore"), ("p", "d2", 1, "hide"), ("p", "d2", 2, "delete-original"),
         ("p", "d3", 1, "delete-both"), ("p", "d4", 1, "delete-original"), ("p", "d4", 2, "delete-translation"), ("p", "d5", 1, "burn"), ("p", "zz", 1, "hide")],
        "project_id string, document_id string, seq int, action string")
    got = {r.document_id: (r.hidden, r.original is not None, r.translation is not None) for r in C.apply_catalog_actions(c, actions).collect()}
    assert got == {"d0": (True, True, True), "d1": (False, True, True), "d2": (False, False, True), "d5": (False, True, True)}
    assert {(r.document_id, r.reason) for r in C.rejected_actions(c, actions).collect()} == {("d5", "unknown action"), ("zz", "unknown document")}


def test_import(spark):
    _, f, p = tables(spark, [], [file("original", "C_orig/s/a.pdf", "a")])
    incoming = spark.createDataFrame(
        [("p", 1, "s", "a.pdf", None), ("p", 2, "s", "b.pdf", "x.markdown"), ("p", 3, "s", "b.pdf", None), ("p", 4, "../s", "c.pdf", None), ("p", 5, "", "c.doc", None)],
        "project_id string, seq int, folder string, original_name string, translation_name string")
    got = {r.seq: (r.translation_path, r.rejected) for r in C.import_batch(f, incoming, p).collect()}
    assert got == {1: (None, "name exists"), 2: ("C_trad/s/b.markdown", None), 3: (None, "name exists"), 4: (None, "unsafe folder"), 5: (None, "unsupported file")}


def summary(spark, *docs):
    rows = [("p", i, t, (path, i, 1, at, "x"), None) for i, t, path, at in docs]
    reference = "struct<relative_path:string,sha256:string,size:long,modified_at:long,media_type:string>"
    return spark.createDataFrame(rows, f"project_id string, document_id string, title string, original {reference}, translation {reference}")


def folders(spark, *paths):
    return spark.createDataFrame([("p", p) for p in paths], "project_id string, relative_path string")


def walk(nodes, sort):
    return [r["key"] for r in nodes.orderBy(*L.tree_order(sort)).collect()]


def test_tree(spark):
    docs = summary(spark, ("root", "Raíz", "D_orig/Raíz.pdf", 1), ("nested", "Artículo", "D_orig/Teoría/Instituciones/Artículo.pdf", 1))
    nodes = L.library_tree(docs, folders(spark, "Teoría", "Teoría/Instituciones", "Vacía"))
    down = ["folder:Teoría", "folder:Teoría/Instituciones", "document:nested", "folder:Vacía", "document:root"]
    assert walk(nodes, "name-asc") == down
    up = L.library_tree(docs, folders(spark, "Teoría/Instituciones", "Vacía"), "name-desc")
    assert walk(up, "name-desc") == ["folder:Vacía", "folder:Teoría", "folder:Teoría/Instituciones", "document:nested", "document:root"]
    opened = spark.createDataFrame([("p", "Teoría")], "project_id string, path string")
    assert walk(L.visible_nodes(nodes, opened), "name-asc") == ["folder:Teoría", "folder:Teoría/Instituciones", "folder:Vacía", "document:root"]


def test_tree_by_time(spark):
    docs = summary(spark, ("old", "Antiguo", "D_orig/Antiguo.pdf", 1), ("new", "Nuevo", "D_orig/Nuevo.pdf", 10), ("b", "B", "D_orig/B.pdf", 10))
    assert walk(L.library_tree(docs, folders(spark), "modified-desc"), "modified-desc") == ["document:b", "document:new", "document:old"]
    assert walk(L.library_tree(docs, folders(spark), "modified-asc"), "modified-asc") == ["document:old", "document:b", "document:new"]


def test_recents(spark):
    rows = [(1, f"p{i}", f"n{i}", f"/Home/{i}/x" if i % 2 else f"/home/{i - 1}/x", f"2024-01-{i + 1:02d}") for i in range(12)] + [(1, "p0", "n0", "/z/x", "2024-02-01"), (1, "bad", "", "/q/x", "2024-03-01")]
    opened = spark.createDataFrame(rows, "reader_id int, project_id string, name string, root string, opened_at string")
    got = [r.project_id for r in C.recent_projects(opened).orderBy("place").collect()]
    assert got == ["p0", "p11", "p10", "p9", "p8", "p7", "p6", "p5"]
    places = [r.location for r in C.recent_locations(opened).orderBy("place").collect()]
    assert places[:3] == ["/q", "/z", "/Home/11"]
    assert C.present_pair_state is not None and F is not None


def test_scans_number_new_records_after_old_ones(spark):
    """Of records with one key, the older takes the counterpart that a later scan finds."""

    def scan(catalog, files, label):
        c = catalog if catalog is not None else spark.createDataFrame([], schemas.CATALOG)
        _, f, p = tables(spark, [], files)
        found = C.reconcile(c, f, p, label)
        rows = [(r.project_id, r.document_id, r.ordinal, r.original, r.translation, r.hidden) for r in found.collect()]
        return rows, spark.createDataFrame(rows, schemas.CATALOG)

    z, a, b = file("original", "C_orig/z/text.pdf", "z"), file("original", "C_orig/b.pdf", "b"), file("original", "C_orig/a.pdf", "a")
    rows, catalog = scan(None, [z, a, b], "1")
    assert [(r[2], r[3].relative_path) for r in sorted(rows, key=lambda r: r[2])] == [(0, "C_orig/a.pdf"), (1, "C_orig/b.pdf"), (2, "C_orig/z/text.pdf")]
    old = next(r[1] for r in rows if r[2] == 2)
    # A second text with the same key, earlier by path, and last its translation.
    more = file("original", "C_orig/z/text.PDF", "y")
    rows, catalog = scan(catalog, [z, a, b, more], "2")
    assert max(rows, key=lambda r: r[2])[3].relative_path == "C_orig/z/text.PDF" and len({r[2] for r in rows}) == len(rows)
    rows, _ = scan(catalog, [z, a, b, more, file("translation", "C_trad/z/text.md", "t")], "3")
    paired = [r for r in rows if r[4] is not None]
    assert len(paired) == 1 and len(rows) == 4
    assert paired[0][1] == old
