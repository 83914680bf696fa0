"""N-gram Jaccard join as a blocked sparse matrix product of documents by shingles.

1. Shingles go to buckets of their hash, which count in how many texts each occurs and
   tell the texts that hold repeated ones.
2. A text's rarest shingles, as many as its size says a similar text cannot all miss, are its
   prefix; only texts with a common prefix shingle can be similar.
3. Every text joins the block of its most common prefix shingle.  A block is multiplied
   with the texts that share a prefix shingle with one of its members: tiles of the
   document-by-shingle matrix, whose products are overlap counts.  Pairs live inside a
   tile's product and are never rows.
4. Links unite texts into components by alternating star contractions.

Texts with the same words are one class and counted with their multiplicity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext.llm.common import LOWER, UPPER, Encoder, same, staged, text_blocks

LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
BLOCK_CHARS = 3 << 20  # words of a block are held as objects, ten times its size
TILE = 1 << 17  # shingles of a side of a tile, plus 64 per text
COLUMNS = 4096  # shingles multiplied at once
FILTER_BITS = 1 << 22
SALTS = 16  # tasks of one block in joins by block
REMEMBER = 150_000  # word hashes a worker keeps

_word_hashes: dict[bytes, int] = {}


def split_words(text: str | None) -> list[bytes]:
    """Words of a text in lower case (A-Z only), as bytes."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []


def class_of(words: list[bytes]) -> int:
    """Signed 64-bit name of a word sequence."""
    return int.from_bytes(hashlib.md5(b" ".join(words)).digest()[:8], "little", signed=True)


def shingle_sets(texts: list[list[bytes]], width: int) -> list[np.ndarray]:
    """For each word list its distinct shingles as sorted 64-bit hashes; a shorter list is one shingle, an empty one none."""
    if len(_word_hashes) > REMEMBER:
        _word_hashes.clear()
    known, name = _word_hashes, xxhash.xxh3_64_intdigest
    for words in texts:
        for w in words:
            if w not in known:
                known[w] = name(w)
    get = known.__getitem__
    hashes = np.fromiter((h for words in texts for h in map(get, words)), dtype=np.uint64)
    factor = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(width)], dtype=np.uint64)

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    count = max(0, len(hashes) - width + 1)
    rolled = np.zeros(count, dtype=np.uint64)
    for k in range(width):
        rolled += hashes[k : k + count] * factor[k]
    rolled = mixed(rolled)
    out, lo = [], 0
    for words in texts:
        n = len(words)
        if n >= width:
            out.append(np.unique(rolled[lo : lo + n - width + 1]))
        else:
            out.append(mixed((hashes[lo : lo + n] * factor[:n]).sum(keepdims=True) + np.uint64(n)) if n else hashes[:0])
        lo += n
    return out


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[list[bytes]]]]:
    Encoder.forget()
    for batch in batches:
        for part in text_blocks(batch["text"].tolist(), BLOCK_CHARS):
            some = batch.iloc[part]
            yield some, [split_words(t) for t in some["text"]]


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of which a similar set has at least one, in any fixed order."""
    return n - (n * percent + 99) // 100 + 1


def _repeated(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Per block of documents: its rows (id, class, size), and which of their shingles occur in two texts or more."""

    def scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId() << 32
        for some, words in _blocks(batches):
            sets = shingle_sets(words, width)
            names = [class_of(w) if w else None for w in words]
            # Without nulls inside: a column of integers with nulls would go through doubles.
            rows = [
                {"id": i, "known": k, "cls": c or 0, "n": len(s)}
                for i, k, c, s in zip(some["id"].tolist(), some["known"].tolist(), names, sets, strict=True)
            ]
            yield pd.DataFrame({"bucket": [-1 - block % buckets], "block": [block], "lows": [b""], "counts": [b""], "wide": [False], "docs": [rows]})
            # A class once per block: copies do not make a shingle common.
            first = {c: k for k, c in reversed(list(enumerate(names))) if c is not None}
            at = sorted(first.values())
            if at:
                flat = np.concatenate([sets[k] for k in at])
                owner = np.repeat(np.array(at), [len(sets[k]) for k in at])
                bucket = ((flat >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                filled = [b for b in range(buckets) if ends[b] < ends[b + 1]]
                parts = [order[ends[b] : ends[b + 1]] for b in filled]
                wide = max(map(len, sets)) >= 65536
                yield pd.DataFrame({
                    "bucket": filled, "block": block,
                    "lows": [flat[p].astype("<u4").tobytes() for p in parts],
                    "counts": [np.bincount(owner[p], minlength=len(rows)).astype("<u4" if wide else "<u2").tobytes() for p in parts],
                    "wide": wide, "docs": [None] * len(filled),
                })
            block += 1

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        if group["bucket"].iloc[0] < 0:
            return pd.DataFrame({"block": group["block"], "docs": group["docs"], "owner": None, "keys": None, "counts": None})
        lows = [np.frombuffer(x, "<u4") for x in group["lows"]]
        flat, bucket = np.concatenate(lows), int(group["bucket"].iloc[0])
        _, back, count = np.unique(flat, return_inverse=True, return_counts=True)
        count, out, lo = count[back], [], 0
        for block, own, found, wide in zip(group["block"], lows, group["counts"], group["wide"], strict=True):
            here = count[lo : lo + len(own)]
            many = here > 1
            lo += len(own)
            if many.any():
                per = np.frombuffer(found, "<u4" if wide else "<u2")
                owner = np.repeat(np.arange(len(per)), per)[many].astype("<u4")
                keys = (np.uint64(bucket) << np.uint64(32)) | own[many].astype(np.uint64)
                out.append((block, None, owner.tobytes(), keys.astype("<i8").tobytes(), here[many].astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["block", "docs", "owner", "keys", "counts"])

    sent = docs.mapInPandas(
        scatter, "bucket long, block long, lows binary, counts binary, wide boolean, docs array<struct<id: long, known: boolean, cls: long, n: int>>"
    )
    return sent.groupBy("bucket").applyInPandas(
        gather, "block long, docs array<struct<id: long, known: boolean, cls: long, n: int>>, owner binary, keys binary, counts binary"
    )


def _prefixes(repeated: DataFrame, percent: int) -> DataFrame:
    """Prefix entries (key, cls, n): the repeated shingles among the rarest of each text."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        rows = [r for docs in group["docs"] if docs is not None for r in docs]
        n = np.array([r["n"] for r in rows], dtype=np.int64)
        told = group[group["owner"].notna()]
        empty = pd.DataFrame({"key": [], "cls": [], "n": []})
        if told.empty or not len(n):
            return empty
        owner = np.concatenate([np.frombuffer(x, "<u4") for x in told["owner"]]).astype(np.int64)
        keys = np.concatenate([np.frombuffer(x, "<i8") for x in told["keys"]])
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in told["counts"]])
        order = np.lexsort((keys, counts, owner))
        owner, keys = owner[order], keys[order]
        held = np.bincount(owner, minlength=len(n))
        place = np.arange(len(owner)) - np.repeat(np.cumsum(held) - held, held)
        # Shingles that occur once come first in the order and find nobody.
        room = prefix_size(n, percent) - (n - held)
        use = place < room[owner]
        cls = [rows[o]["cls"] for o in owner[use]]
        return pd.DataFrame({"key": keys[use], "cls": np.array(cls, dtype=np.int64), "n": n[owner[use]]})

    return repeated.groupBy("block").applyInPandas(choose, "key long, cls long, n int").distinct()


def _wanted_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Shingles of the classes in ``wanted``, once per class.

    A bit filter of fixed size (512 kB) spares most other texts the way; the join settles the rest.
    """
    bits = (
        wanted.select(F.pmod("cls", F.lit(FILTER_BITS)).alias("bit"))
        .groupBy(F.expr("bit div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 32))")).alias("bits")).collect()
    )
    words = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    for r in bits:
        words[r["word"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for _, split in _blocks(batches):
            found = {}
            for words in split:
                if words:
                    bit = (c := class_of(words)) % FILTER_BITS
                    if table[bit >> 5] >> np.uint32(bit & 31) & np.uint32(1):
                        found[c] = words
            sets = shingle_sets(list(found.values()), width)
            if found:
                yield pd.DataFrame({"cls": list(found), "shingles": [s.astype("<u8").tobytes() for s in sets]})

    sets = docs.select("text").mapInPandas(measure, "cls long, shingles binary")
    return sets.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("shingles").alias("shingles"))


def overlap_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: the product of the incidence matrices, by blocks of columns."""
    a, b = np.concatenate(left), np.concatenate(right)
    a_of, b_of = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right))
    both = np.intersect1d(a, b)
    total = np.zeros((len(left), len(right)), dtype=np.float64)
    if not len(both):
        return total.astype(np.int64)
    sides = []
    for flat, of in ((a, a_of), (b, b_of)):
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = both[at] == flat
        at, of = at[hit], of[hit]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], of[order]))
    for lo in range(0, len(both), COLUMNS):
        blocks = []
        for (at, of), rows in zip(sides, (len(left), len(right)), strict=True):
            part = slice(*np.searchsorted(at, [lo, lo + COLUMNS]))
            block = np.zeros((rows, min(COLUMNS, len(both) - lo)), dtype=np.float32)
            block[of[part], at[part] - lo] = 1
            blocks.append(block)
        total += blocks[0] @ blocks[1].T
    return total.astype(np.int64)


def _multiply(units: DataFrame, percent: int) -> DataFrame:
    """Per tile and text: documents linked with it there, and the least representative that its links reach there."""

    def tile(group: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for member in (True, False):
            side = group[group["member"] == member]
            sides.append((side["rep"].to_numpy(), side["copies"].to_numpy(), side["own"].to_numpy(dtype=bool), [np.frombuffer(x, "<u8") for x in side["shingles"]]))
        (x, x_copies, _, xs), (y, y_copies, own, ys) = sides
        if not len(x) or not len(y):
            return pd.DataFrame({"rep": [], "links": [], "label": []})
        nx, ny = np.array([len(s) for s in xs])[:, None], np.array([len(s) for s in ys])[None, :]
        able = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & (x[:, None] != y[None, :])
        r, c = np.flatnonzero(able.any(1)), np.flatnonzero(able.any(0))
        if not len(r):
            return pd.DataFrame({"rep": [], "links": [], "label": []})
        common = overlap_counts([xs[k] for k in r], [ys[k] for k in c])
        link = able[np.ix_(r, c)] & (100 * common >= percent * (nx[r] + ny[:, c] - common))
        x, y, own = x[r], y[c], own[c]
        x_links = link @ y_copies[c]
        y_links = np.where(own, 0, x_copies[r] @ link)  # members of the block count as rows
        least_x, least_y, far = x.copy(), y.copy(), np.iinfo(np.int64).max
        while True:
            new_x = np.minimum(least_x, np.where(link, least_y[None, :], far).min(1))
            new_y = np.minimum(least_y, np.where(link, new_x[:, None], far).min(0))
            if (new_x == least_x).all() and (new_y == least_y).all():
                break
            least_x, least_y = new_x, new_y
        out = pd.DataFrame({"rep": np.concatenate([x, y]), "links": np.concatenate([x_links, y_links]), "label": np.concatenate([least_x, least_y])})
        return out[np.concatenate([link.any(1), link.any(0)])]

    return units.groupBy("block", "i", "j").applyInPandas(tile, "rep long, links long, label long")


def _with_block(side: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (block, cls, …) with the columns of their block, of which ``blocks`` has one row; a block of many rows is dealt to
    ``SALTS`` tasks, each with a copy of that row."""
    salted = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = side.withColumn("_salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int"))
    return own.join(salted, ["block", "_salt"]).drop("_salt")


def star_components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b), by large-star and small-star rounds: (a, root) for all but the roots."""
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        # Large star: larger neighbours move to the least of the neighbourhood.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "v")
        edges = both.join(least, F.col("a") == F.col("v")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: smaller neighbours, and the vertex, move to the least of them.
        least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "v")
        moved = edges.join(least, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(moved.union(least.select("v", "m")).where("a <> b").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            return edges.withColumnRenamed("b", "root")
        seen = now


def link_similar(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Per document (id, n_shingles, n_links, component_id) of the similarity graph.

    Two documents link when their sets of ``width``-word shingles have ``percent`` hundredths or more of
    their union in common; n_links counts the linked documents, copies included, and component_id is the
    least identifier reachable.  Fewer words than ``width``: the sequence is the one shingle.  No words or null
    text: no shingles, no links, its own component.  Null identifiers: such a document links like any other,
    and only where all of a component are null is its component_id null.  Repeated rows are copies; different texts under one
    identifier are different documents, each with its own links.  Other columns play no part.  Shingles are compared by 64-bit hashes.  An empty table gives an empty one.
    """
    spark = docs.sparkSession
    number = F.col(id).cast("long")
    docs = docs.select(F.coalesce(number, F.lit(0)).alias("id"), number.isNotNull().alias("known"), F.col(text).alias("text"))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    repeated = staged(_repeated(docs, width, buckets), "repeated")
    rows = repeated.where("docs IS NOT NULL").select(F.explode("docs").alias("d")).selectExpr(
        "if(d.known, d.id, NULL) AS id", "if(d.n > 0, d.cls, NULL) AS cls", "d.n AS n"
    )
    classes = (
        rows.where("cls IS NOT NULL").groupBy("cls")
        .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"))
    )
    entries = staged(_prefixes(repeated, percent), "entries")
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    entries = staged(entries.join(sizes, "key"), "entries")
    block_of = staged(
        entries.groupBy("cls").agg(F.max(F.struct("m", "key")).alias("best"), F.first("n").alias("n"))
        .select("cls", F.col("best.key").alias("block"), "n").join(classes.drop("n"), "cls"), "blocks",
    ).withColumn("rep", F.col("cls"))
    placed = entries.select("key", "cls").join(block_of.select("cls", F.col("block").alias("own_block")), "cls")
    meets = placed.select("key", F.col("own_block").alias("block")).distinct()
    partners = (
        placed.join(meets, "key").where("own_block <= block").select("block", "cls", (F.col("own_block") == F.col("block")).alias("own")).distinct()
        .join(block_of.select("cls", "n"), "cls")
    )
    weight = F.col("n") + 64
    inside = block_of.groupBy("block").agg(F.sum(weight).alias("x_weight"), F.min("n").alias("low"), F.max("n").alias("high"))
    partners = staged(
        _with_block(partners, inside.select("block", "low", "high"))
        .where((100 * F.col("n") >= percent * F.col("low")) & (percent * F.col("n") <= 100 * F.col("high"))), "partners",
    )
    tiles = (
        inside.join(partners.groupBy("block").agg(F.sum(weight).alias("y_weight"), F.count(F.lit(1)).alias("partners")), "block")
        .where("partners > 1")
        .select("block", F.expr(f"x_weight div {TILE} + 1").alias("rows"), F.expr(f"y_weight div {TILE} + 1").alias("cols"))
    )

    def spread(side: DataFrame, member: bool) -> DataFrame:
        # A side's own tile by hash, and all tiles of the other side.
        mine, other = ("rows", "cols") if member else ("cols", "rows")
        at = F.pmod(F.xxhash64("cls"), F.col(mine))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        return _with_block(side, tiles).select(
            "block", *([at.alias("i"), every.alias("j")] if member else [every.alias("i"), at.alias("j")]),
            F.lit(member).alias("member"), "own", "cls",
        )

    units = spread(block_of.withColumn("own", F.lit(True)), True).unionByName(spread(partners, False))
    units = staged(units, "units")
    sets = _wanted_sets(docs, units.select("cls").distinct(), width)
    sets = sets.join(block_of.select("cls", "rep", "copies"), "cls")
    found = staged(_multiply(units.join(sets, "cls"), percent), "links")
    roots = star_components(found.select(F.col("rep").alias("a"), F.col("label").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = block_of.select("cls", "rep", "least").join(links, "rep").join(roots, F.col("rep") == F.col("a"), "left")
    component = F.coalesce("root", "rep")
    known = staged(known.select("cls", "least", "links", component.alias("root")), "known")
    # Classes are known by their own names throughout: an identifier may stand under several texts.
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    linked = known.join(least, "root").select("cls", "links", "component")
    named = classes.select("cls", "least", "copies").join(linked, "cls", "left").select(
        F.col("cls").alias("c"), F.coalesce("component", "least").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
    )
    return rows.join(named, same(F.col("cls"), F.col("c")), "left").select(
        F.col("id").alias(id), F.col("n").cast("long").alias("n_shingles"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
