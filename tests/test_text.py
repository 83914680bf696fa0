import pytest
from pyspark.sql import functions as F

from bitext.functions import paths as P
from bitext.functions import text as T

PROSE = (
    "Gauges along the river are read every morning, and the readings travel by wire to the town hall before noon. "
    "Nobody remembers who decided on the hour, but the ledgers agree on it since the first page."
)


def apply(spark, fn, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_usable_text(spark):
    assert apply(spark, T.usable_text, "scan", "�" * 200, PROSE) == [False, False, True]


def test_normalize_page(spark):
    assert apply(
        spark, T.normalize_page,
        "Political institu-\ntions matter.\nThey persist.\n\n2 Methods",
        "a  b\r\n\r\n\r\nso­ft\n \n", " \n ",
    ) == ["Political institutions matter. They persist.\n\n2 Methods", "a b\n\nsoft", ""]


def test_classify_block(spark):
    assert apply(
        spark, T.classify_block,
        "A short introduction to the model.", "Γr(Y) = ∑ YijYji. (2)", "Fig. 1 The uniform distribution over a network.",
        "Table 1: ERGM fit for the conflict network.", "2 Methods", "Gráfica III — tendencia", "see https://x.org",
        "$$x$$", "Ecuación (3)", "Platform design of the study",
    ) == ["paragraph", "equation-marker", "figure-marker", "table-marker", "heading", "figure-marker", "paragraph",
          "equation-marker", "equation-marker", "heading"]


def test_citation(spark):
    assert apply(spark, T.looks_like_citation, "1. Author: Journal 12, 2020.", "1. First step", "«cita»", "vol. 3",
                 "the press released", "impression") == [True, False, True, False, True, False]


def test_strip_reader_metadata(spark):
    text = "<!-- seg_00007 · página 1 -->\nTexto traducido.\n\n<!-- seg_00008 · página 2 -->\nMás texto."
    assert apply(spark, T.strip_reader_metadata, text) == ["\nTexto traducido.\n\nMás texto."]


def test_value_tokens(spark):
    text = "The estimate is -0.25 (2011), 7 %, abc12, mail a.b@x.org; see https://doi.org/10.1/test."
    assert apply(spark, T.numeric_tokens, text) == [["-0.25", "2011", "7 %", "2", "10.1"]]
    assert apply(spark, T.reference_tokens, text) == [["a.b@x.org", "https://doi.org/10.1/test."]]


def test_trim_strips_every_space_and_leaves_plain_ends(spark):
    # texts that begin and end with plain characters are not searched.
    assert apply(
        spark, T.trim, "a b", " a", "a\n", "\u00a0\u3000a \u2009b\ufeff\t", "é ", "\u0085x\u0085", "", " \n ", None, "~", "\x7f ", "𝒳", "á"
    ) == ["a b", "a", "a", "a \u2009b", "é", "\u0085x\u0085", "", "", None, "~", "\x7f", "𝒳", "á"]


def test_utf16_length(spark):
    assert apply(spark, T.utf16_len, "a😀b", "") == [4, 0]


def test_sentences_lose_nothing(spark):
    text = 'He said "no." Then 3.5 came!  What?'
    assert apply(spark, T.sentences, text) == [['He said "no."', "Then 3.5 came!", "What?"]]


def test_sentence_groups_keep_abbreviations(spark):
    first = "Dr. Smith read the gauge below the mill every morning for thirty years, and she never once wrote it down late."
    second = "Her ledgers survive in the cellar of the town hall, where the ink has browned but every figure can still be read."
    assert apply(spark, T.sentence_groups, f"{first} {second}", "", "one") == [[first, second], [], ["one"]]


def plain_groups(sentences, low=90, high=360):
    groups = []
    for s in sentences:
        if groups and (len(groups[-1]) < low or (len(s) < low and len(groups[-1]) + 1 + len(s) <= high)):
            groups[-1] += " " + s
        else:
            groups.append(s)
    if len(groups) > 1 and len(groups[-1]) < low and len(groups[-2]) + 1 + len(groups[-1]) <= high:
        groups[-2:] = [groups[-2] + " " + groups[-1]]
    return groups


def test_sentence_groups_against_brute_force(spark):
    import random

    rng = random.Random(3)
    texts = [["x" * rng.randint(1, 200) + "." for _ in range(rng.randint(1, 12))] for _ in range(60)]
    assert apply(spark, T.sentence_groups, *[" ".join(t) for t in texts]) == [plain_groups(t) for t in texts]


def test_pack_sentences(spark):
    import random

    rng = random.Random(4)
    texts = [["y" * rng.randint(1, 900) + "." for _ in range(rng.randint(1, 8))] for _ in range(40)]
    packed = apply(spark, T.pack_sentences, *[" ".join(t) for t in texts])
    for sentences, chunks in zip(texts, packed):
        whole = " ".join(sentences)
        assert " ".join(chunks) == whole
        assert all(len(c) <= 1400 for c in chunks)
        if len(whole) > 1400:  # no chunk had room for the next sentence
            for a, b in zip(chunks, chunks[1:]):
                assert len(a) + 1 + len(b.split(" ")[0]) > 1400


@pytest.mark.parametrize(
    "path, directory, key",
    [
        ("C_orig/Sub/Paper.PDF", "C_orig", "sub/paper"), ("C_trad/Paper.ES.md", "C_trad", "paper"),
        ("C_trad/paper.fr.es.md", "C_trad", "paper.fr"), ("C_trad\\a\\b.txt", "C_trad", "a/b"),
        ("other/.pdf", "C_orig", "other/.pdf"), ("C_orig/x.de", "C_orig", "x"),
    ],
)
def test_pair_key(spark, path, directory, key):
    assert apply(spark, lambda c: P.pair_key(c, F.lit(directory)), path) == [key]


def test_paths(spark):
    assert apply(spark, P.ancestors, "Teoría/Instituciones", "") == [["Teoría", "Teoría/Instituciones"], []]
    assert apply(spark, lambda c: P.document_folder(c, F.lit(None)), "D_orig\\Teoría\\Instituciones\\A.pdf", "D_orig/A.pdf") == ["Teoría/Instituciones", ""]
    assert apply(spark, P.safe_path, "a/b", "/a", "a/../b", "a:b", "a. /b", " ") == [True, False, False, False, False, False]
    assert apply(spark, P.media_type, "PDF", "markdown", "txt") == ["application/pdf", "text/markdown", "text/plain"]


def test_names_sort_naturally(spark):
    names = ["Capítulo 10", "capitulo 9", "Ñandú", "nz", "Oso", "árbol", "10", "2"]
    keys = apply(spark, P.sort_name, *names)
    assert [n for _, n in sorted(zip(keys, names))] == ["2", "10", "árbol", "capitulo 9", "Capítulo 10", "nz", "Ñandú", "Oso"]


def test_texts_without_a_sign_are_not_searched(spark):
    # F16 F22: every text was searched for placeholders and references.
    values = ["plain 12 words", "see https://a.b/c) and DOI: 10.1/x", "x.y@z.org", "⟦MATH_INLINE_00001⟧ NUMBER_00002 [REFERENCE_00003]", "⟦NUMBER_1", "", None]
    for found, pattern in ((T.reference_tokens, T.K.REFERENCE), (T.math_placeholders, T.K.MATH_PLACEHOLDER)):
        assert apply(spark, found, *values) == apply(spark, lambda c, p=pattern: T.tokens(c, p), *values)
    assert apply(spark, T.stable_placeholders, *values) == [[], [], [], ["[[NUMBER_00002]]", "[[REFERENCE_00003]]"], [], [], None]
    searched = F.array(F.raise_error(F.lit("searched")).cast("string"))
    assert apply(spark, lambda c: T._none_without(c, ["@", ":"], searched), "plain", "") == [[], []]
