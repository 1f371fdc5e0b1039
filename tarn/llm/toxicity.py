"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary labelled texts. Their counts are continuation counts, the
number of different words before an n-gram, so copied passages weigh nothing. They share their
backoff, the counts that the discount took from either class, so an expression that is rare in both
weighs the same in both and says nothing. A text's evidence is its log-likelihood under one model less that
under the other, normalised by its length; a logistic curve on it, fitted on folds that the models
have not seen, gives the score.

Bound: the models are fitted on about MOST_LABELLED labelled texts at the most (whole texts), chosen by a
hash of their ids; the models take as many texts of either class, so that neither backs off more
than the other, and the curve takes all. Statistics of n-grams seen fewer than LEAST times are summed, not kept.

Edge cases: null and empty texts have no evidence and score by the curve's constant; without
labelled rows of both classes every score is the share of toxic labels, or 0; repeated rows each get their row;
several labels of one id count as toxic if one is; an empty table gives no rows; a text of any length is scored
whole, one at a time. score() keeps extra columns and expects none named like its own; keep_clean() takes any.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .runtime import bounded_sample, give_back, ship

if TYPE_CHECKING:
    import pandas as pd  # not in workers, which would keep it

MOST_LABELLED = 16_000
#: Counts up to the discount carry no weight of their own: they go to the shared backoff.
LEAST, DISCOUNT, FOLDS, CUT = 3, 2.0, 4, 0.7
#: Log-likelihood ratio from which one word is strong evidence.
STRONG = 1.0
_START = np.uint64(0x5851F42D4C957F2D)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, hash of the word and the one before it, text) of each word of a block."""
    words = tx.Words(data, offsets, NOT_WORD)
    h = words.hashes()
    before = np.empty_like(h)
    if len(h):
        before[1:] = h[:-1]
        first = words.bounds[:-1][words.per_text > 0]
        before[first] = _START
    return h, tx.mix(before * np.uint64(3) + h), words.text_of


#: Words here are runs of letters, digits and bytes beyond ASCII: punctuation doesn't make another word.
NOT_WORD = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])


class KneserNey:
    """Word and bigram tables of both classes, in sorted arrays: [hash, count by class]."""

    def __init__(self, table: pd.DataFrame, totals: np.ndarray, shared: int):
        """table: kind (1 word, 2 bigram), gram, context, c0, c1, f0, f1 (types that follow it), spread (counts up to the discount, both classes)."""
        words, pairs = table[table.kind == 1].sort_values("gram"), table[table.kind == 2].sort_values("gram")
        self.word, self.pair = words.gram.to_numpy(np.int64), pairs.gram.to_numpy(np.int64)
        c = words[["c0", "c1"]].to_numpy(np.float64)
        total = np.maximum(totals.astype(np.float64), 1)
        # Shared backoff: what the discount took from either class, one more for the unseen.
        self.floor = 1.0 / (shared + 1)
        spread = np.maximum(words.spread.to_numpy(np.float64), 1) / (shared + 1)
        kept = np.maximum(c - DISCOUNT, 0)
        left = 1 - kept.sum(0) / total
        self.word_p = kept / total + left * spread[:, None]
        self.unseen_p = left * self.floor
        pc = pairs[["c0", "c1"]].to_numpy(np.float64)
        # Types that follow each context, and the mass that it leaves to the lower order.
        follow = words[["f0", "f1"]].to_numpy(np.float64)
        gain, used = np.maximum(pc - DISCOUNT, 0), np.zeros_like(c)
        self.pair_p = np.zeros_like(pc)
        if len(pairs) and len(words):
            of = pairs.context.to_numpy(np.int64)
            at = np.minimum(np.searchsorted(self.word, of), len(self.word) - 1)
            known = self.word[at] == of
            self.pair_p[known] = gain[known] / np.maximum(follow[at[known]], 1)
            np.add.at(used, at[known], gain[known])
        self.left = np.where(follow > 0, 1 - used / np.maximum(follow, 1), 1.0)

    def ratio(self, h: np.ndarray, pair: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Log-likelihood ratio of each of n texts, each distinct bigram of a text once; and its part above STRONG a word."""
        if not len(h):
            return np.zeros((2, n))
        p, w = np.tile(self.unseen_p, (len(h), 1)), h.view(np.int64)
        left = np.ones((len(h), 2))
        if len(self.word):
            at = np.minimum(np.searchsorted(self.word, w), len(self.word) - 1)
            known = self.word[at] == w
            p[known] = self.word_p[at[known]]
            follows = np.zeros(len(h), bool)
            follows[1:] = known[:-1] & (text[1:] == text[:-1])
            left[follows] = self.left[at[np.flatnonzero(follows) - 1]]
        p *= left
        if len(self.pair):
            q = pair.view(np.int64)
            at = np.minimum(np.searchsorted(self.pair, q), len(self.pair) - 1)
            known = self.pair[at] == q
            p[known] += self.pair_p[at[known]]
        once = distinct(pair, text)
        log = np.log(p[once, 1] / p[once, 0])
        return np.stack([np.bincount(text[once], log, n), np.bincount(text[once], np.maximum(log - STRONG, 0), n)])


def distinct(pair: np.ndarray, text: np.ndarray) -> np.ndarray:
    """One place of each distinct (text, bigram)."""
    key = pair ^ tx.mix(text.astype(np.uint64) + np.uint64(1))
    by = np.argsort(key)
    return by[np.append(True, key[by][1:] != key[by][:-1])] if len(by) else by


def inputs(ratio: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the curve sees: the ratio a word, the strong part by the root of the length, and a constant."""
    n = np.maximum(n, 1)
    strong = ratio[1] / np.sqrt(n)
    return np.stack([np.clip(ratio[0] / n, -1, 1), np.clip(strong, 0, 3), np.log1p(ratio[1]), np.log(n) / 5, np.ones(len(n))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        w += np.linalg.solve((x * s[:, None]).T @ x + ridge * len(y) * np.eye(len(w)), x.T @ (y - p) - ridge * len(y) * w)
    return w


def gram_types(sample: DataFrame) -> DataFrame:
    """Each distinct (words before, context, word) of the sample with the folds that hold it, a bit each, by class.

    Types, not tokens: a passage that is copied a thousand times counts as once.
    """

    def run(batches):
        for batch in batches:
            toxic, fold = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for lo, data, offsets in tx.blocks(batch.column(0)):
                h, pair, text = grams(data, offsets)
                if not len(h):
                    continue
                start = np.append(True, text[1:] != text[:-1])
                before = np.where(start, _START, np.append(_START, h[:-1]))
                triple = tx.mix(np.where(start, _START, np.append(_START, pair[:-1])) * np.uint64(5) + h)
                bit = 1 << fold[lo + text]
                out = {"triple": tx.signed(triple), "gram": tx.signed(pair), "context": tx.signed(before), "ends": tx.signed(h), "m0": bit * (toxic[lo + text] == 0), "m1": bit * (toxic[lo + text] == 1)}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    rows = sample.select(F.col("text").cast("string"), "toxic", "fold").mapInArrow(tx.lean(run), "triple bigint, gram bigint, context bigint, ends bigint, m0 bigint, m1 bigint")
    return rows.groupBy("triple", "gram", "context", "ends").agg(F.bit_or("m0").alias("m0"), F.bit_or("m1").alias("m1"))


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, least: int = LEAST) -> tuple[KneserNey, np.ndarray] | float:
    """The models and the curve's weights, from labelled rows of docs; or the share of toxic ones where a class is missing."""
    spark = docs.sparkSession
    ship(spark)
    give_back(spark)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    there = known.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("order", F.xxhash64("doc_id"))
    picked = bounded_sample(there, "doc_id", most_labelled).toPandas().sort_values(["order", "doc_id"], ignore_index=True)
    if picked.toxic.nunique() < 2:
        return float(picked.toxic.mean()) if len(picked) else 0.0
    picked["fold"] = np.arange(len(picked)) % FOLDS
    # As many of each class teach the models; the others only help to set the curve.
    place = picked.groupby("toxic").cumcount()
    picked["teach"] = (place < picked.toxic.value_counts().min()).astype(int)
    # picked has at most most_labelled rows of three numbers.
    # An Arrow table: a list would go through Python workers of a second kind, which stay beside the others.
    rows = spark.createDataFrame(pa.table({c: pa.array(picked[c].to_numpy(), pa.int64()) for c in ("doc_id", "toxic", "fold", "teach")}))
    sample = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    without = [None, *range(FOLDS)]
    names = [(f, c, f"n{f}_{c}") for f in without for c in (0, 1)]
    seen_in = lambda f, c: F.sum(F.when(F.col(f"m{c}").bitwiseAND((1 << FOLDS) - 1 - (0 if f is None else 1 << f)) != 0, 1).otherwise(0))
    pairs = gram_types(sample.where("teach = 1")).groupBy("gram", "context", "ends").agg(*(seen_in(f, c).alias(n) for f, c, n in names), F.bit_or("m0").alias("m0"), F.bit_or("m1").alias("m1")).persist()
    words = pairs.groupBy("ends").agg(*(seen_in(f, c).alias(n) for f, c, n in names), F.lit(0).alias("none"))
    spread = sum(F.least(F.col(f"nNone_{c}"), F.lit(int(DISCOUNT))) for c in (0, 1)).cast("long").alias("spread")
    words = words.select(F.lit(1).alias("kind"), F.col("ends").alias("gram"), F.lit(0).cast("long").alias("context"), *(n for *_, n in names), spread).persist()
    follow = pairs.groupBy("context").agg(*(F.sum(n).alias(f"f_{n}") for *_, n in names)).withColumnRenamed("context", "gram")
    sums = words.agg(*(F.sum(n).alias(n) for *_, n in names), F.sum("spread").alias("shared")).first()
    shared = sums["shared"] or 0
    common = lambda t: t.where(F.col("nNone_0") + F.col("nNone_1") >= least)
    two = common(pairs).select(F.lit(2).alias("kind"), "gram", "context", *(n for *_, n in names), F.lit(0).cast("long").alias("spread"), *(F.lit(0).cast("long").alias(f"f_{n}") for *_, n in names))
    # Grams of a bounded sample.
    table = common(words).join(follow, "gram", "left").na.fill(0).unionByName(two).toPandas()
    pairs.unpersist(), words.unpersist()

    def model(f: int | None) -> KneserNey:
        t = table[["kind", "gram", "context", "spread"]].assign(**{f"c{c}": table[f"n{f}_{c}"] for c in (0, 1)}, **{f"f{c}": table[f"f_n{f}_{c}"] for c in (0, 1)})
        return KneserNey(t, np.array([sums[f"n{f}_{c}"] or 0 for c in (0, 1)]), shared)

    held = spark.sparkContext.broadcast([model(f) for f in range(FOLDS)])

    def evidence(batches):
        for batch in batches:
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            ratios, sizes = np.zeros((2, len(fold))), np.zeros(len(fold))
            for lo, data, offsets in tx.blocks(batch.column(0)):
                h, pair, text = grams(data, offsets)
                n = len(offsets) - 1
                per = np.stack([m.ratio(h, pair, text, n) for m in held.value])
                ratios[:, lo : lo + n] = per[fold[lo : lo + n], :, np.arange(n)].T
                sizes[lo : lo + n] = np.bincount(text[distinct(pair, text)], minlength=n)
            yield pa.RecordBatch.from_arrays([pa.array(ratios[0]), pa.array(ratios[1]), pa.array(sizes), batch.column(1)], ["ratio", "strong", "n", "toxic"])

    seen = sample.select(F.col("text").cast("string"), "toxic", "fold").mapInArrow(tx.lean(evidence), "ratio double, strong double, n double, toxic bigint").toPandas()
    held.destroy()
    return model(None), logistic(inputs(seen[["ratio", "strong"]].to_numpy().T, seen.n.to_numpy()), seen.toxic.to_numpy(float))


def score(docs: DataFrame, model, text: str = "text") -> DataFrame:
    """docs with toxic_score (0 to 1), toxic_ratio (log-likelihood ratio) and toxic_words."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            ratios, sizes, scores = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, data, offsets in tx.blocks(batch.column(at).cast(pa.string())):
                h, pair, owner = grams(data, offsets)
                n = len(offsets) - 1
                size = np.bincount(owner[distinct(pair, owner)], minlength=n)
                if isinstance(shared.value, float):
                    ratio, s = np.zeros((2, n)), np.full(n, shared.value)
                else:
                    lm, weights = shared.value
                    ratio = lm.ratio(h, pair, owner, n)
                    s = 1 / (1 + np.exp(-np.clip(inputs(ratio, size) @ weights, -30, 30)))
                ratios.append(ratio[0]), sizes.append(size), scores.append(s)
            cols = [pa.array(np.concatenate(x)) for x in (scores, ratios, sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "toxic_score", "toxic_ratio", "toxic_words"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tx.lean(run), f"{schema}, toxic_score double, toxic_ratio double, toxic_words bigint")


def keep_clean(docs: DataFrame, model) -> DataFrame:
    """docs, all columns as they were, without the documents that score CUT or more."""
    whole = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return score(whole, model).where(F.col("toxic_score") < CUT).select("row.*")


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the toxicity contract."""
    ship(docs.sparkSession)
    model = train(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= CUT).cast("int").alias("predicted")
    )
