"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text are computed in tasks, in one pass over whole texts.  The
model is fitted on the driver from at most ``TRAIN_ROWS`` labelled documents,
those with the smallest hash of their id, whose ids are looked up by a broadcast
of that size: columns are cut into at most ``BINS`` quantile bins, trees grow
level by level from gradient and Hessian histograms under logistic loss.  All
trees are flattened into arrays (feature, threshold, left child, value), and a
batch of documents walks them together in numpy, one step per level.

Defined results: a null or empty text has statistics of zero and is scored like
any other; rows with a null id or label are not learnt from; without labelled
rows, or with one class only, every score is the smoothed share of class 1;
statistics are finite for any text; repeated rows get equal scores; an empty
table gives an empty result; only the text is read for a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecairn.llm.common import ship, table, whole_text

#: Labelled documents that are learnt from at most.
TRAIN_ROWS = 20_000
BINS = 64
TREES, DEPTH, RATE = 80, 4, 0.15
MIN_ROWS, L2 = 20, 1.0
CUT = 0.3

STATISTICS = (
    "log_chars", "log_words", "mean_word", "distinct_words", "log_lines", "mean_line", "repeated_lines",
    "upper", "digits", "blanks", "stops", "commas", "marks", "symbols", "bars", "longest_word",
    "single_words", "capitalized", "repeat_next", "compressed",
)



def statistics_of(text: str) -> list[float]:
    """One number per name in ``STATISTICS``."""
    words, n = text.split(), len(text)
    if not words:
        return [0.0] * len(STATISTICS)
    w = len(words)
    lines = [s for s in text.split("\n") if s and not s.isspace()]
    count = text.count
    raw = text.encode("utf-8", "surrogatepass")
    distinct = len(set(words))
    ascii_upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&<>{}[]=\\^~_@/"))
    letters = sum(map(len, words))
    return [
        float(np.log1p(n)),
        float(np.log1p(w)),
        letters / w,
        distinct / w,
        float(np.log1p(len(lines))),
        n / len(lines) if lines else float(n),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        ascii_upper / n,
        digits / n,
        (n - letters) / n,
        (count(".") + count("?")) / w,
        count(",") / w,
        (count("!") + count(";") + count(":")) / w,
        symbols / n,
        count("|") / w,
        float(np.log1p(max(map(len, words)))),
        sum(len(x) == 1 for x in words) / w,
        sum(x[0].isupper() for x in words) / w,
        sum(a == b for a, b in zip(words, words[1:])) / w,
        len(zlib.compress(raw, 1)) / len(raw),
    ]


@dataclass
class Forest:
    """Trees laid end to end; a leaf is its own left child and sends every row left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values for each row of ``x``."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[rows, self.feature[at]] > self.threshold[at]
            at = self.left[at] + right
        return self.start + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boosted trees; thresholds lie between neighbouring bins."""
    n = len(y)
    share = (float(y.sum()) + 1) / (n + 2)
    start = float(np.log(share / (1 - share)))
    whole = lambda f, t, l, v, r: Forest(
        np.array(f, dtype=np.int64), np.array(t), np.array(l, dtype=np.int64), np.array(v), np.array(r, dtype=np.int64), start, depth
    )
    if n == 0 or y.min() == y.max():
        return whole([0], [np.inf], [0], [0.0], [0])
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(n_features)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(n_features)], axis=1)
    offsets = np.arange(n_features) * BINS
    raw = np.full(n, start)
    feature: list[int] = []
    threshold: list[float] = []
    left: list[int] = []
    value: list[float] = []
    roots: list[int] = []

    def add() -> int:
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(left))
        value.append(0.0)
        return len(left) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        root = add()
        roots.append(root)
        grow = [(root, np.arange(n))]
        leaves: list[tuple[int, np.ndarray]] = []
        for _ in range(depth):
            deeper = []
            for node, rows in grow:
                split = _best_split(binned[rows], g[rows], h[rows], offsets, edges)
                if split is None:
                    leaves.append((node, rows))
                    continue
                j, b = split
                feature[node], threshold[node] = j, float(edges[j][b])
                a = add()
                c = add()
                left[node] = a
                goes = binned[rows, j] > b
                deeper += [(a, rows[~goes]), (c, rows[goes])]
            grow = deeper
        for node, rows in leaves + grow:
            value[node] = float(-rate * g[rows].sum() / (h[rows].sum() + L2))
            raw[rows] += value[node]
    return whole(feature, threshold, left, value, roots)


def _best_split(binned: np.ndarray, g: np.ndarray, h: np.ndarray, offsets: np.ndarray, edges: list[np.ndarray]) -> tuple[int, int] | None:
    if len(g) < 2 * MIN_ROWS:
        return None
    n_features = binned.shape[1]
    keys = (binned + offsets).ravel()
    sums = [
        np.bincount(keys, weights=np.repeat(w, n_features), minlength=n_features * BINS).reshape(n_features, BINS).cumsum(axis=1)
        for w in (g, h, np.ones_like(g))
    ]
    gl, hl, nl = sums
    gt, ht, nt = (s[:, -1:] for s in sums)
    gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
    allowed = (nl >= MIN_ROWS) & (nt - nl >= MIN_ROWS)
    gain = np.where(allowed, gain, 0.0)
    best = int(gain.argmax())
    j, b = divmod(best, BINS)
    if gain[j, b] <= 1e-6 or b >= len(edges[j]):
        return None
    return j, b


def _rows_of(texts: list[str]) -> np.ndarray:
    return np.array([statistics_of(t) for t in texts]).reshape(len(texts), len(STATISTICS))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = _rows_of(batch.column("text").to_pylist()).ravel()
        ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(STATISTICS))
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["label", "x"]
        )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Forest:
    """``labels``: ``doc_id`` and ``label`` (0 or 1) of the rows that may be learnt from."""
    chosen = (
        labels.select(F.col("doc_id").alias("labelled_id"), F.col("label").cast("double").alias("label"))
        .where("labelled_id is not null and label is not null")
        .orderBy(F.xxhash64("labelled_id"), "labelled_id", "label")
        .limit(train_rows)
    )
    found = (
        docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))
        .select("label", "text")
        .mapInArrow(_statistics, "label double, x array<double>")
        .orderBy("x", "label")  # a fixed order of sums
        .toPandas()
    )
    x = np.array(found["x"].tolist()).reshape(len(found), len(STATISTICS))
    return fit(x, found["label"].to_numpy(dtype=float))


def quality_scores(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``doc_id, score, predicted`` for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 2000):
                score = forest.score(_rows_of(texts[at : at + 2000]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, 2000), pa.array(score), pa.array((score >= cut).astype(np.int32))],
                    names=["doc_id", "score", "predicted"],
                )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double, predicted int")


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold() != 0).select("doc_id", F.col("quality").alias("label"))
    scored = quality_scores(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted")
