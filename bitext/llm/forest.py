"""Quality rules with an isolation forest over the statistics of the rules.

A document that breaks a plain rule goes.  Of the others, an isolation forest
judges the statistics: random splits isolate unusual documents on short paths.
The forest and its threshold come from labelled documents, a bounded and fixed
sample of them; the statistics and the verdict cover every whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitext.llm.common import WORD, running, staged, without

WORDS = re.compile(WORD)
SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 5

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULT = [*BASE, "base_failed", "anomaly", "kept"]
RESULT_TYPES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, anomaly double, kept boolean"

# Statistics that the forest splits on, all of them shares or means, so that they compare across lengths.
FEATURES = ["mean_word", "symbols", "dup_lines", "repeats", "capitals", "digits", "marks", "distinct", "top_word", "marked_words"]


def repeated_words(words: list[str]) -> int:
    """Words inside windows of five that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    name = ids
    for width in range(1, WINDOW):
        # The name of a longer window is the pair (name of the shorter, next word), renamed densely.
        pair = name[: len(ids) - width] * len(number) + ids[width:]
        name = np.unique(pair, return_inverse=True)[1].astype(np.int64) if width < WINDOW - 1 else pair
    _, back, count = np.unique(name, return_inverse=True, return_counts=True)
    hit = count[back] > 1
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, np.flatnonzero(hit), 1)
    np.add.at(covered, np.flatnonzero(hit) + WINDOW, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of the plain rules, and the features of the forest, of a whole text."""
    text = text or ""
    words = WORDS.findall(text)
    n = len(words)
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    dup = len(lines) - len(set(lines))
    symbols = len(SYMBOLS.findall(text))
    chars = sum(map(len, words))
    repeat = repeated_words(words)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    capital = (codes >= 65) & (codes <= 90) | (codes >= 0xC0) & (codes <= 0xDE)
    small = (codes >= 97) & (codes <= 122) | (codes >= 0xDF)
    digit = (codes >= 48) & (codes <= 57)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    marked = sum(1 for w in words if not w[-1].isalnum())
    n_, c_ = max(n, 1), max(chars, 1)
    features = [
        chars / n_, symbols / c_, dup / max(len(lines), 1), repeat / n_, capital.sum() / c_, digit.sum() / c_,
        (~(capital | small | digit)).sum() / c_,
        # Distinct words fall with length like a power; the exponent does not.
        math.log(max(len(counts), 1)) / math.log(n) if n > 1 else 1.0,
        max(counts.values(), default=0) / n_, marked / n_,
    ]
    return [n, chars, symbols, dup, repeat], [float(v) for v in features]


def base_failed(counts: list[int]) -> bool:
    n, *_, repeat = counts
    return n < 10 or 100 * repeat > 20 * n


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 2.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big))


@dataclass
class Forest:
    """Random trees as flat arrays, a row per tree; a leaf points to itself, the right child follows the left."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    depth: np.ndarray  # of leaves: depth plus the mean path of the points left there
    height: int
    sample: int
    threshold: float = 1.0
    labelled: int = 0  # documents that the threshold was calibrated on

    @classmethod
    def fit(
        cls, rows: np.ndarray, box: np.ndarray | None = None, trees: int = 128, sample: int = 256, height: int = 14, seed: int = 7,
        picks: np.ndarray | None = None,
    ) -> Forest:
        """Trees over samples of ``rows``, split anywhere in the ``box`` (least and greatest values) of a node.

        ``picks`` has the rows of each tree, where they were drawn before.

        Splits fall into the whole box, not only between the points of a node: a statistic that is constant among
        the points still cuts off what lies elsewhere in the box, in a leaf without points and on a short path.
        """
        random = np.random.RandomState(seed)
        sample = min(sample, len(rows)) if picks is None else picks.shape[1]
        box = np.stack([rows.min(0), rows.max(0)]) if box is None else box
        grown = []
        for tree in range(trees):
            feature, split, left, depth = [0], [np.inf], [0], [0.0]
            drawn = random.choice(len(rows), sample, replace=False) if picks is None else picks[tree]
            open_ = [(0, 0, rows[drawn], box)]
            while open_:
                node, deep, part, box_ = open_.pop()
                wide = np.flatnonzero(box_[1] > box_[0])
                if deep == height or len(part) <= 1 or not len(wide):
                    depth[node] = deep + float(_mean_path(len(part)))
                    continue
                f = wide[random.randint(len(wide))]
                at = random.uniform(box_[0, f], box_[1, f])
                below, low, high = part[:, f] < at, box_.copy(), box_.copy()
                low[1, f] = high[0, f] = at
                feature[node], split[node], left[node] = f, at, len(left)
                open_ += [(len(left), deep + 1, part[below], low), (len(left) + 1, deep + 1, part[~below], high)]
                for values, new in ((feature, 0), (split, np.inf), (depth, 0.0)):
                    values += [new, new]
                left += [len(left), len(left) + 1]
            grown.append((feature, split, left, depth))
        size = max(len(g[0]) for g in grown)
        pad = lambda k, kind: np.array([g[k] + [0] * (size - len(g[k])) for g in grown], dtype=kind)
        return cls(pad(0, np.int32), pad(1, float), pad(2, np.int64), pad(3, float), height, sample)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly between 0 and 1; points on short paths are near 1."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, split, left, depth in zip(self.feature, self.split, self.left, self.depth, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.height):
                down = left[node]
                node = np.where(down == node, node, down + (rows[every, feature[node]] >= split[node]))
            total += depth[node]
        return np.exp2(-total / len(self.feature) / max(float(_mean_path(self.sample)), 1e-9))

    def calibrate(self, good: np.ndarray, bad: np.ndarray, good_loss: float) -> None:
        """The score above which a document goes: best balance of the labels, at most ``good_loss`` of the good lost."""
        good, bad = np.sort(self.scores(good)), np.sort(self.scores(bad)) if len(bad) else np.zeros(0)
        least = np.quantile(good, 1 - good_loss, method="higher")
        if not len(bad):
            self.threshold = float(good[-1])
            return
        edges = np.unique(np.concatenate([good[good >= least], bad[bad >= least], [least]]))
        caught = len(bad) - np.searchsorted(bad, edges, "right")
        lost = len(good) - np.searchsorted(good, edges, "right")
        gain = caught / len(bad) - lost / len(good)
        best = np.flatnonzero(gain == gain.max())
        # Any threshold between two neighbouring scores judges the labelled rows alike: take the middle.
        lo = edges[best[-1]]
        later = edges[edges > lo]
        self.threshold = float((lo + later[0]) / 2 if len(later) else lo)


def fit_forest(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", quality: str = "quality",
    label_rows: int | None = None, trees: int = 128, sample: int = 256, good_loss: float = 0.001, seed: int = 7,
) -> Forest | None:
    """A forest over documents labelled good, its threshold calibrated on documents labelled good or bad.

    All labels count; ``label_rows`` bounds them where it is given: those with the smallest hash of their identifier, whatever the size
    of the table.  Of several labels of an identifier the worst counts, of several texts the least, so that the order of
    rows plays no part.  None where no labelled good document passes the plain rules.  A tree is grown from ``sample`` documents drawn
    from all good ones, as the method has it: these are all that reaches the driver.  The box is that of all labelled
    documents, and the threshold is found on the scores of all of them, counted by score in Spark.
    """
    chosen = (
        labels.where(F.col(quality).isNotNull() & F.col(id).isNotNull())
        .groupBy(F.col(id).alias("_label")).agg(F.min(quality).alias("_quality"))
    )
    if label_rows is not None:
        chosen = chosen.orderBy(F.xxhash64("_label", F.lit(seed)), "_label").limit(label_rows)
    types = "label long, good int, features array<double>"

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [statistics(t) for t in batch["text"]]
            keep = [not base_failed(c) for c, _ in found]
            measured = pd.DataFrame({"label": batch["label"], "good": (batch["quality"] > 0).astype("int32"), "features": [f for _, f in found]})
            yield measured[keep]

    joined = docs.select(F.col(id).alias("_id"), F.col(text).alias("text")).join(
        chosen, F.col("_id") == F.col("_label")
    ).groupBy(F.col("_label").cast("long").alias("label"), F.col("_quality").cast("int").alias("quality")).agg(F.min("text").alias("text"))
    rows = staged(joined.mapInPandas(measure, types), "labelled")
    ends = [f(F.col("features")[k]) for f in (F.min, F.max) for k in range(len(FEATURES))]
    n, *box = rows.agg(F.coalesce(F.sum("good"), F.lit(0)), *ends).first()
    if not n:
        return None
    # Places among the good documents in the order of their labels, drawn for each tree; the documents there come to the driver.
    random = np.random.default_rng(seed)
    picks = np.array([random.choice(n, min(sample, n), replace=False) for _ in range(trees)])
    places = np.unique(picks)
    wanted = docs.sparkSession.createDataFrame([(int(p),) for p in places], "_wanted long")
    ranked = running(rows.where("good = 1"), [], ["label"], {"_place": F.lit(1)}, "good")
    drawn = ranked.join(F.broadcast(wanted), F.col("_place") == F.col("_wanted")).orderBy("_place").select("features").collect()
    good = np.array([r["features"] for r in drawn], dtype=float)
    forest = Forest.fit(good, np.array(box, dtype=float).reshape(2, -1), trees, seed=seed, picks=np.searchsorted(places, picks))
    forest.threshold, forest.labelled = _calibrated(forest, rows, good_loss)
    return forest


def _calibrated(forest: Forest, rows: DataFrame, good_loss: float) -> tuple[float, int]:
    """What ``Forest.calibrate`` finds, over a table: rows are counted by score, and running sums over the scores tell what each loses and catches."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            features = np.array(batch["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"score": forest.scores(features), "good": batch["good"]})

    scored = rows.mapInPandas(score, "score double, good int")
    by_score = scored.groupBy("score").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    edges = staged(running(by_score, [], ["score"], {"good_below": F.col("good"), "bad_below": F.col("bad")}, "scores"), "edges")
    n_good, n_bad, greatest = edges.agg(F.sum("good"), F.sum("bad"), F.max(F.when(F.col("good") > 0, F.col("score")))).first()
    if not n_bad:
        return float(greatest), n_good
    # The quantile as numpy's "higher" takes it.
    at = int(np.ceil((n_good - 1) * (1 - good_loss)))
    least = edges.where((F.col("good") > 0) & (F.col("good_below") + F.col("good") > at)).agg(F.min("score")).first()[0]
    caught = (F.lit(n_bad) - F.col("bad_below") - F.col("bad")) / F.lit(float(n_bad))
    lost = (F.lit(n_good) - F.col("good_below") - F.col("good")) / F.lit(float(n_good))
    best = edges.where(F.col("score") >= least).select("score", (caught - lost).alias("gain")).orderBy(F.desc("gain"), F.desc("score")).first()
    later = edges.where(F.col("score") > best["score"]).agg(F.min("score")).first()[0]
    return float(best["score"] if later is None else (best["score"] + later) / 2), n_good + n_bad


def judge(docs: DataFrame, forest: Forest | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the counts of the rules, base_failed, anomaly and kept.

    Fewer than 10 words, or more than a fifth of the words in repeated windows: base_failed.  Others
    are kept unless their anomaly exceeds the forest's threshold; without a forest (no usable
    labels) all others are kept, and anomaly is null.  A null text has no words.  Columns of ``docs`` named
    like a result column give way; an empty table gives an empty one.
    """
    kept = without(docs, RESULT)
    out = docs.select(F.struct(*kept).alias("row"), F.col(text).alias("text"))

    @F.pandas_udf(RESULT_TYPES)
    def verdict(texts: pd.Series) -> pd.DataFrame:
        found = [statistics(t) for t in texts]
        result = pd.DataFrame(np.array([c for c, _ in found], dtype=np.int64).reshape(-1, len(BASE)), columns=BASE)
        result["base_failed"] = failed = np.array([base_failed(c) for c, _ in found], dtype=bool)
        if forest is None:
            result["anomaly"], result["kept"] = pd.Series(dtype=float), ~failed
        else:
            features = np.array([f for _, f in found], dtype=float).reshape(-1, len(FEATURES))
            result["anomaly"] = scores = forest.scores(features)
            result["kept"] = ~failed & (scores <= forest.threshold)
        return result

    return out.withColumn("verdict", verdict("text")).select("row.*", "verdict.*")
