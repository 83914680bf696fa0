import functools
import itertools
import zlib

import numpy as np
import pytest

from bitext.llm import common, token_files


@functools.cache
def plain(tokenizer):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer)


def ids_of(tokenizer, text):
    return [*plain(tokenizer).encode(text or "", add_special_tokens=False).ids, 0]


def encoded(encoder, texts):
    ids, bounds = encoder.encode(texts)
    return [ids[lo:hi].tolist() for lo, hi in itertools.pairwise(bounds)]


def test_pieces_encode_like_the_tokenizer(tokenizer):
    texts = [
        "It's  a  test,\n\n  of\tblanks \n", "naïve—word… “x”,y !!! 12,345.67 don't DON'T", " lead", "trail ", " em space\x1cfile\x85next", "日本語 text，mixed",
        "<|endoftext|> is an id", "a  <|endoftext|>\n\nb <|endoftext", "a\r\nb\x0b\x0cc  \n d", "😀😀 é", "", None, "word'sword 'quote' ½x x½ ²",
    ]
    assert encoded(common.Encoder(tokenizer), texts) == [ids_of(tokenizer, t)[:-1] for t in texts]


def test_random_texts_encode_like_the_tokenizer(tokenizer):
    random = np.random.RandomState(3)
    marks = list("ab Z\n\t .,'!?é—0½  　s") + [*"×ß\x1f\x85", "'s", "  ", "\r\n", "<|endoftext|>"]
    texts = ["".join(random.choice(marks, random.randint(1, 40))) for _ in range(2000)]
    assert encoded(common.Encoder(tokenizer), texts) == [ids_of(tokenizer, t)[:-1] for t in texts]


def test_known_pieces_are_forgotten(tokenizer):
    encoder, whole = common.Encoder(tokenizer, remember=2), common.Encoder(tokenizer)
    for text in ("a b c d", "e f g h", "a b c d", "x", "e f g h i", "a"):
        assert encoded(encoder, [text]) == encoded(whole, [text])
        assert len(encoder.known) <= 6


def test_round_trip(spark, odd, tokenizer, tmp_path):
    token_files.write_tokens(odd, f"file://{tmp_path}/ids", tokenizer)
    rows = token_files.read_tokens(spark, f"file://{tmp_path}/ids").orderBy("start").collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text) for r in odd.collect()), key=lambda r: r[:2])
    assert [(r.doc_id is not None, r.doc_id or 0) for r in rows] == [w[:2] for w in want]
    start = 0
    for r in rows:
        assert r.start == start and r.n_tokens == len(r.ids)
        start += r.n_tokens
    texts = {}
    for _, i, t in want:
        texts.setdefault(i, []).append(ids_of(tokenizer, t))
    for r in rows:
        texts[r.doc_id or 0].remove(list(r.ids))
    assert not any(texts.values())
    digests = token_files.read_tokens(spark, f"file://{tmp_path}/ids", digest=True).orderBy("start").collect()
    assert [r.ids_crc32 for r in digests] == [zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows]


def test_short_document_access_and_dictionary(spark, tokenizer, tmp_path):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('Shared words stand in every text, number ', id, ' of them.') AS text")
    path = f"file://{tmp_path}/ids"
    token_files.write_tokens(docs, path, tokenizer)
    first = token_files.parts(spark, path).orderBy("part").first()
    file = token_files.TokenFile(path, first.file)
    assert file.ids(3).tolist() == ids_of(tokenizer, f"Shared words stand in every text, number {file.index['id'][3]} of them.")
    assert (tmp_path / "ids" / "dictionary").stat().st_size > 0
    (tmp_path / "ids" / "dictionary").write_bytes(b"another")
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.TokenFile(path, first.file)


def test_empty_table(spark, none, tokenizer, tmp_path):
    token_files.write_tokens(none, f"file://{tmp_path}/ids", tokenizer)
    assert token_files.read_tokens(spark, f"file://{tmp_path}/ids").collect() == []
