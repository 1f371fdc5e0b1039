"""Quality rules: countable rules first, then an isolation forest over rule statistics.

Statistics of each text are counted exactly. An isolation forest grown on good labelled rows gives
each text the mean path length over random splits; short paths mean that few texts look like it.
The cut is set from labelled rows: the lowest anomaly score that rejects at most `most_good` of the
good ones. Rows are fitted on a bounded sample, `most_labelled`, chosen by a hash of their ids.

Edge cases: null and empty texts have zero statistics and fail the base rule; with fewer than
LEAST_GOOD good labelled rows that pass the base rule, or no low-quality one, the forest keeps every text that passes it; repeated rows each get their row; ties in the sample are
broken by id; an empty table gives no rows; texts of any length are read whole, one at a time; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .runtime import Scratch, bounded_sample

WINDOW = 8
#: Bounds of the fit: labelled rows, trees, rows a tree.
MOST_LABELLED, TREES, TREE_ROWS = 20_000, 100, 256
#: Good labelled rows, half of which grow the forest and half set its cut, below which there is none.
LEAST_GOOD = 16
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_chars_all", "n_bars")
IS_SYMBOL, IS_UPPER, IS_DIGIT, IS_MARK = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b"!?.,;:"))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """COUNTS of each text of a block, one column each."""
    n = len(offsets) - 1
    words = tx.Words(data, offsets)
    character = (data & 0xC0) != 0x80
    seeds = tx.mix(np.arange(1, n + 1, dtype=np.uint64))
    spans = tx.SpanHash(tx.byte_values(data))

    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    start = np.concatenate([offsets[:-1], breaks + 1])
    line_text = np.concatenate([np.arange(n), owner])
    order = np.lexsort((start, line_text))
    start, line_text = start[order], line_text[order]
    end = np.append(start[1:] - 1, len(data))
    last = np.append(line_text[1:] != line_text[:-1], True)
    end[last] = offsets[line_text[last] + 1]
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(words.inside, out=filled[1:])
    wordy = filled[end] > filled[start]
    line_text, key = line_text[wordy], spans(start[wordy], end[wordy]) ^ seeds[line_text[wordy]]
    by = np.argsort(key, kind="stable")
    again = np.zeros(len(by), bool)
    again[1:] = key[by][1:] == key[by][:-1]
    dup_lines = np.bincount(line_text[by[again]], minlength=n)

    repeat_words = np.zeros(n, np.int64)
    text = words.text_of
    m = len(words) - WINDOW + 1
    if m > 0:
        h = tx.SpanHash(spans(words.start, words.end)).windows(WINDOW)
        at = np.flatnonzero(text[:m] == text[WINDOW - 1 :])
        key = h[at] ^ seeds[text[at]]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        twice = np.zeros(len(by), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[by[twice]]
        cover = np.zeros(len(words) + 1, np.int32)
        cover[hit] += 1  # each hit is another place
        cover[hit + WINDOW] -= 1
        repeat_words = np.bincount(text[np.cumsum(cover[:-1]) > 0], minlength=n)

    total = lambda flags: tx.per_text_sum(flags, offsets)
    return np.stack([
        words.per_text, total(character & words.inside), total(IS_SYMBOL[data]), dup_lines, repeat_words, np.bincount(line_text, minlength=n),
        total(IS_UPPER[data]), total(IS_DIGIT[data]), total(IS_MARK[data]), total(character), total(data == 124),
    ], axis=1)


def rule_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and COUNTS (long) for each row."""

    def run(batches):
        for batch in batches:
            parts = [statistics(data, offsets) for _, data, offsets in tx.blocks(batch.column(1))]
            counts = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, i].astype(np.int64)) for i in range(len(COUNTS)))], ["key", *COUNTS])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(tx.lean(run), f"key {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))
    return out.withColumnRenamed("key", key)


def features(counts: np.ndarray) -> np.ndarray:
    """Rates that don't depend on a text's length; repeated windows are left to the base rule."""
    w, chars, symbols, dup_lines, _, lines, upper, digits, marks, _, bars = counts.astype(np.float64).T
    words, letters = np.maximum(w, 1), np.maximum(chars, 1)
    return np.sqrt(np.stack([chars / words, symbols / words, upper / letters, digits / letters, marks / words, bars / words, dup_lines / np.maximum(lines, 1)], axis=1))


class IsolationForest:
    """Trees of random axis splits in flat arrays; a leaf adds the mean path of its rows.

    Half of the cuts fall within the rows of a node, half within the node's part of `box`, the range of all
    labelled rows: a statistic that no good text shows, like symbols in plain prose, is split on too.
    Only the first `width` columns are looked at.
    """

    def __init__(self, rows: np.ndarray, box: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7, width: int | None = None):
        rng = np.random.default_rng(seed)
        rows, box = rows[:, :width], box[:, :width]
        self.size = min(tree_rows, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(self.size, 2))))) + 4
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], box, rng) for _ in range(trees)]

    @staticmethod
    def mean_path(n: float) -> float:
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, box: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, value = [], [], [], [], []

        def node(x: np.ndarray, low: np.ndarray, high: np.ndarray, d: int) -> int:
            i = len(feature)
            for column, v in ((feature, -1), (cut, 0.0), (left, i), (right, i), (value, d + self.mean_path(len(x)))):
                column.append(v)
            lo, hi = (low, high) if rng.random() < 0.5 or len(x) < 2 else (x.min(axis=0), x.max(axis=0))
            wide = np.flatnonzero(hi > lo)
            if d < self.depth and len(x) > 1 and len(wide):
                f = int(rng.choice(wide))
                c = rng.uniform(lo[f], hi[f])
                feature[i], cut[i] = f, c
                under, over = high.copy(), low.copy()
                under[f] = over[f] = c
                left[i], right[i] = node(x[x[:, f] < c], low, under, d + 1), node(x[x[:, f] >= c], over, high, d + 1)
            return i

        node(rows, box[0], box[1], 0)
        return tuple(map(np.array, (feature, cut, left, right, value)))

    def anomaly(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for outliers, below 0.5 for the common."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, np.where(rows[every, np.maximum(f, 0)] < cut[at], left[at], right[at]))
            total += value[at]
        return 2 ** (-total / len(self.trees) / max(self.mean_path(self.size), 1e-9))


def fit(good: np.ndarray, bad: np.ndarray, most_good: float = 0.005) -> tuple[IsolationForest, float] | None:
    """The forest of half of the good rows, and the anomaly score above which a text goes.

    The cut is the one with the best balanced accuracy on the other half and the bad rows, among
    those that reject at most most_good of the good. The last column, the share of duplicate lines, counts
    unless a forest without it is better by that measure: where good texts repeat lines as well, it only blurs the rest.
    """
    if len(good) < LEAST_GOOD or not len(bad):
        return None
    every = np.concatenate([good, bad])
    best, most = None, -np.inf
    for width in (every.shape[1], every.shape[1] - 1):
        forest = IsolationForest(good[::2], np.stack([every.min(axis=0), every.max(axis=0)]), width=width)
        g, b = np.sort(forest.anomaly(good[1::2])), np.sort(forest.anomaly(bad))
        cuts = np.unique(np.concatenate([g, b]))
        lost = 1 - np.searchsorted(g, cuts, "right") / len(g)
        caught = 1 - np.searchsorted(b, cuts, "right") / len(b)
        gain = np.where(lost <= most_good, caught - lost, -1)
        if gain.max() > most:
            best, most = (forest, float(cuts[np.flatnonzero(gain == gain.max())[-1]])), gain.max()
    return best


def judge(docs: DataFrame, labels: DataFrame, scratch: Scratch, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, COUNTS, base_failed, anomaly, kept of each row of docs."""
    spark = docs.sparkSession
    counted = scratch.table(rule_statistics(docs), "statistics").withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    )
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = counted.where(~F.col("base_failed")).join(known, "doc_id").select(F.xxhash64("doc_id").alias("order"), "doc_id", "quality", *COUNTS)
    sample = bounded_sample(labelled, "doc_id", most_labelled).toPandas().sort_values(["order", "doc_id", *COUNTS])
    x, y = features(sample[list(COUNTS)].to_numpy().reshape(-1, len(COUNTS))), sample["quality"].to_numpy()
    model = fit(x[y == 1], x[y == 0])
    shared = spark.sparkContext.broadcast(model)

    def run(frames):
        for f in frames:
            if shared.value is None or not len(f):
                f["anomaly"], f["kept"] = 0.0, ~f["base_failed"]
            else:
                forest, cut = shared.value
                f["anomaly"] = forest.anomaly(features(f[list(COUNTS)].to_numpy()))
                f["kept"] = ~f["base_failed"] & (f["anomaly"] <= cut)
            yield f

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counted.schema) + ", anomaly double, kept boolean"
    return counted.mapInPandas(tx.lean(run), schema)


def verdicts(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The columns of the quality contract, and the anomaly score."""
    return judge(docs, labels, scratch).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
