"""Language-model scores by a subword lattice.

A text is its words and one end. A word's probability sums over all its segmentations into pieces of
a public vocabulary, by log-space forward recursion over the lattice. The vocabulary's own scores
weight the pieces: they are merge ranks, read as 1 / (rank + 100), and keep SCORES of each piece's
weight; the rest is the uses that one expectation step over every distinct training word gives it.
One arc more goes from a word's start to its end, with the word's share of the training tokens.
A single weight, for all words, mixes that arc with the lattice: of the WEIGHTS, the one under which
the training tokens are likeliest, each left out of the counts in turn. Words and the end together
have probability one.

Word counts, and the table of every distinct word, cover all documents and are joined, not
broadcast; only words at or above a count that keeps at most HEAD of them are broadcast.

Edge cases: null and empty texts are one end token; without training texts the pieces alone score;
bytes outside the vocabulary have their byte piece; a word of any length is scored whole, and however
unlikely it is, its score is the lattice's; repeated rows each get their row; an empty table gives no rows.
Columns other than doc_id and text are not read, whatever they are called.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .runtime import Scratch

#: Most words whose scores are broadcast (16 bytes each).
HEAD = 1 << 18
LOG10 = np.log(10)
#: Share of a piece's weight that comes from the vocabulary's scores.
SCORES = 0.1
#: Weights of the whole-word arc that are tried.
WEIGHTS = (0.3, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995)
#: Words of one length go through the lattice in lockstep, but one by one where they are fewer than about a third of
#: their length (a hundred at the most), which is quicker then. Ends of a word looked at once.
LOCKSTEP, ENDS = 1, 1 << 14


class Lattice:
    """Pieces as byte strings with log probabilities: those that open a word (after a space), those that go on, and the stop."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, scores = [], []
        for i in range(m.get_piece_size()):
            if m.is_unknown(i) or m.is_control(i):
                continue
            raw = bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in raw[1:]:
                pieces.append(raw)
                scores.append(m.get_score(i))
        for b in range(256):  # any byte can open or continue a word
            pieces += [bytes([b]), b" " + bytes([b])]
            scores += [-1e6, -1e6]
        pieces.append(b" ")
        scores.append(-1e6)
        self.longest = max(map(len, pieces))
        table = pd.DataFrame({"piece": pieces, "score": scores}).groupby("piece", as_index=False).score.max()
        data, offsets = tx.utf8(pa.array(table.piece.tolist(), pa.binary()))
        h = tx.SpanHash(tx.byte_values(data))(offsets[:-1], offsets[1:])
        order = np.argsort(h)
        self.hash = h[order]
        self.opens = np.array([p[:1] == b" " for p in table.piece], bool)[order]
        rank = np.minimum(-table.score.to_numpy()[order], 1e5)
        self.scores = 1.0 / (rank + 100.0)
        self.set(self.scores, 0.35)

    def set(self, weight: np.ndarray, stop: float) -> None:
        """Normalise weights within openers, and within the others with the stop's share."""
        p = weight.copy()
        p[self.opens] /= p[self.opens].sum()
        p[~self.opens] *= (1 - stop) / p[~self.opens].sum()
        self.logp, self.stop = np.log(p), float(np.log(stop))

    def arcs(self, words: np.ndarray, spans: tx.SpanHash, start: np.ndarray, length: int):
        """For words of one length: yield (end, size, piece number or -1 of each word)."""
        for e in range(1, length + 1):
            for size in range(1, min(e, self.longest) + 1):
                h = spans(start + e - size, start + e)
                at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
                yield e, size, np.where(self.hash[at] == h, at, -1)

    def run(self, data: np.ndarray, offsets: np.ndarray, expect: bool = False):
        """ln probability of each word (bytes with a leading space); with expect, also the expected uses of each piece and stop."""
        n = len(offsets) - 1
        size = np.diff(offsets)
        spans = tx.SpanHash(tx.byte_values(data))
        out, uses, stops = np.zeros(n), np.zeros(len(self.hash)), 0.0
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order])) + 1
        for group in np.split(order, cuts):
            length = int(size[group[0]]) if len(group) else 0
            if not length:
                continue
            if len(group) < LOCKSTEP * length / (3 + length / 100):
                for g in group.tolist():
                    out[g], u = self._single(spans, int(offsets[g]), length, expect)
                    if expect:
                        uses += u
                        stops += 1
                continue
            step = max(1, 400_000 // (length * (min(length, self.longest) if expect else 1)))
            for lo in range(0, len(group), step):
                g = group[lo : lo + step]
                total, u = self._same(spans, offsets[g], length, expect)
                out[g] = total
                if expect:
                    uses += u
                    stops += len(g)
        return (out, uses, stops) if expect else out

    def _hits(self, spans: tx.SpanHash, start: int, lo: int, hi: int):
        """(start, end, piece) of the arcs of one word that end in (lo, hi], by end."""
        ends = np.arange(lo + 1, hi + 1)
        found = []
        for size in range(1, min(self.longest, hi) + 1):
            e = ends[ends >= size]
            h = spans(start + e - size, start + e)
            at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            hit = np.flatnonzero(self.hash[at] == h)
            found.append(np.stack([e[hit] - size, e[hit], at[hit]]))
        s, e, at = np.concatenate(found, axis=1)
        by = np.argsort(e, kind="stable")
        return s[by], e[by], at[by]

    def _single(self, spans: tx.SpanHash, start: int, length: int, expect: bool):
        """One word, whatever its length: arcs are found for all places at once, a chunk of ends at a time, and only the sums go place by place."""
        alpha = np.full(length + 1, -np.inf)
        alpha[0] = 0.0
        for lo in range(0, length, ENDS):
            hi = min(lo + ENDS, length)
            s, e, at = self._hits(spans, start, lo, hi)
            base = max(0, lo - self.longest)
            self._sums(alpha[base : hi + 1], s - base, e - base, self.logp[at])
        total = float(alpha[length]) + self.stop
        if not expect:
            return total, None
        beta, uses = np.full(length + 1, -np.inf), np.zeros(len(self.hash))
        beta[length] = self.stop
        for lo in range((length - 1) // ENDS * ENDS, -1, -ENDS):
            hi = min(lo + ENDS, length)
            top = min(length, hi + self.longest)
            # Arcs that start in [lo, hi), seen from the word's end.
            s, e, at = self._hits(spans, start, lo, top)
            own = (s >= lo) & (s < hi)
            s, e, at = s[own], e[own], at[own]
            by = np.argsort(-s, kind="stable")
            back = beta[lo : top + 1][::-1].copy()
            self._sums(back, top - e[by], top - s[by], self.logp[at[by]])
            beta[lo : top + 1] = back[::-1]
            uses += np.bincount(at, np.exp(alpha[s] + self.logp[at] + beta[e] - total), len(self.hash))
        return total, uses

    @staticmethod
    def _sums(values: np.ndarray, source: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        """values[t] = log of the sum of exp(values[s] + w) over the arcs (s, t, w), which come by target."""
        v, src, w = values.tolist(), source.tolist(), weight.tolist()
        cuts = np.flatnonzero(np.diff(target, prepend=-1, append=-1)).tolist()
        heads = target[cuts[:-1]].tolist() if len(target) else []
        for t, lo, hi in zip(heads, cuts[:-1], cuts[1:], strict=True):
            if hi - lo == 1:
                v[t] = v[src[lo]] + w[lo]
                continue
            terms = [v[src[j]] + w[j] for j in range(lo, hi)]
            most = max(terms)
            v[t] = most + math.log(sum([math.exp(x - most) for x in terms])) if most > -math.inf else most
        values[:] = v

    def _same(self, spans: tx.SpanHash, start: np.ndarray, length: int, expect: bool):
        m = len(start)
        alpha = np.full((length + 1, m), -np.inf)
        alpha[0] = 0.0
        kept = []
        for e, size, at in self.arcs(start, spans, start, length):
            hit = np.flatnonzero(at >= 0)
            if not len(hit):
                continue
            lp = self.logp[at[hit]]
            alpha[e, hit] = np.logaddexp(alpha[e, hit], alpha[e - size, hit] + lp)
            if expect:
                kept.append((e, size, hit, at[hit], lp))
        total = alpha[length] + self.stop
        if not expect:
            return total, None
        beta = np.full((length + 1, m), -np.inf)
        beta[length] = self.stop
        uses = np.zeros(len(self.hash))
        for e, size, hit, at, lp in reversed(kept):
            through = beta[e, hit] + lp
            beta[e - size, hit] = np.logaddexp(beta[e - size, hit], through)
            uses += np.bincount(at, np.exp(alpha[e - size, hit] + through - total[hit]), len(self.hash))
        return total, uses


def spaced(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return tx.utf8(pa.array([b" " + w for w in words], pa.binary()))


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    words = tx.Words(tx.LOWER[data], offsets)
    return words, words.hashes(lower=False)


WORD = "h bigint, word binary, n bigint, n_train bigint"


def word_counts(docs: DataFrame) -> DataFrame:
    """Every distinct word with its tokens in all texts and in the training ones; docs: train boolean, text."""

    def run(batches):
        kept: list[pd.DataFrame] = []

        def merged() -> pd.DataFrame:
            f = pd.concat(kept)
            return f.groupby("h", as_index=False, sort=False).agg(word=("word", "first"), n=("n", "sum"), n_train=("n_train", "sum"))

        for batch in batches:
            train = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, data, offsets in tx.blocks(batch.column(1)):
                words, h = word_hashes(data, offsets)
                if not len(h):
                    continue
                distinct, first, of, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                known = np.bincount(of, train[lo + words.text_of].astype(float), len(distinct)).astype(np.int64)
                raw = words.data.tobytes()
                text = [raw[a:b] for a, b in zip(words.start[first], words.end[first], strict=True)]
                kept.append(pd.DataFrame({"h": tx.signed(distinct), "word": text, "n": n.astype(np.int64), "n_train": known}))
                if sum(map(len, kept)) > 600_000:
                    kept = [merged()]
                    if len(kept[0]) > 400_000:
                        yield pa.RecordBatch.from_pandas(kept.pop(), preserve_index=False)
        if kept:
            yield pa.RecordBatch.from_pandas(merged(), preserve_index=False)

    rows = docs.select("train", F.col("text").cast("string")).mapInArrow(tx.lean(run), WORD)
    return rows.groupBy("h", "word").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))


def word_weight(words: DataFrame, n: int, ends: int) -> float:
    """The weight of the whole-word arc: the one of WEIGHTS under which the training tokens are likeliest, each left out of the counts in turn. words: c, lp."""
    if n < 2:
        return 0.5
    own = (F.col("c") - 1) / (n - 1)
    sums = [F.sum(F.col("c") * F.log(own * w + F.exp(F.greatest(F.col("lp"), F.lit(-700.0))) * (1 - w))) for w in WEIGHTS]
    row = words.where("c > 0").agg(*sums).first()
    of_ends = [ends * math.log(max(w * (ends - 1) / (n - 1), 1e-300)) for w in WEIGHTS]
    return max(zip([(x or 0.0) + e for x, e in zip(row, of_ends, strict=True)], WEIGHTS, strict=True))[1]


def corpus_scores(docs: DataFrame, scratch: Scratch, vocabulary: str, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs: doc_id, train boolean, text."""
    spark = docs.sparkSession
    words = scratch.table(word_counts(docs), "words")
    totals = words.agg(F.sum("n_train").alias("n"), F.sum(F.when(F.col("n_train") > 0, 1)).alias("v"), F.sum(F.least(F.col("n_train"), F.lit(1))).alias("seen")).first()
    ends = docs.where("train").count()
    n, v = int(totals["n"] or 0) + ends, int(totals["v"] or 0) + (ends > 0)

    lattice = Lattice(vocabulary)
    start = spark.sparkContext.broadcast(lattice)

    def expect(batches):
        uses, stops = np.zeros(len(start.value.hash)), 0.0
        for batch in batches:
            if batch.num_rows:
                _, u, s = start.value.run(*spaced(batch.column(0).to_pylist()), expect=True)
                uses, stops = uses + u, stops + s
        at = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(uses[at], stops))], ["piece", "uses"])

    # One row a piece and task, summed: bounded by the vocabulary.
    found = words.where("n_train > 0").select("word").mapInArrow(tx.lean(expect), "piece bigint, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
    stops = float(found.uses[found.piece == -1].sum())
    if stops:
        uses = np.zeros(len(lattice.hash))
        kept = found[found.piece >= 0]
        uses[kept.piece.to_numpy()] = kept.uses.to_numpy()
        stop = min(0.95, max(0.05, stops / (stops + uses[~lattice.opens].sum())))
        weight = lattice.scores.copy()
        for side in (lattice.opens, ~lattice.opens):
            weight[side] *= SCORES / weight[side].sum()
            if uses[side].sum():
                weight[side] += uses[side] * ((1 - SCORES) / uses[side].sum())
        lattice.set(weight, stop)
    model = spark.sparkContext.broadcast(lattice)

    def arcs(batches):
        for batch in batches:
            c = batch.column(3).to_numpy(zero_copy_only=False).astype(float)
            lp = model.value.run(*spaced(batch.column(1).to_pylist())) if batch.num_rows else np.zeros(0)
            base = np.log10((c + 1) / (n + 1 * (v + 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(base), pa.array(lp)], ["h", "n", "c", "base", "lp"])
        tx.release()

    pieces = scratch.table(words.mapInArrow(arcs, "h bigint, n bigint, c bigint, base double, lp double"), "pieces")
    scratch.drop("words")
    weight = word_weight(pieces, n, ends)
    own = F.log(F.col("c") * (weight / max(n, 1)))  # null for words that training lacks
    apart = F.col("lp") + math.log(1 - weight)
    high = F.greatest(own, apart)
    mixed = F.when(F.col("c") > 0, high + F.log1p(F.exp(F.least(own, apart) - high))).otherwise(apart)
    scored = pieces.select("h", "n", (F.col("c") > 0).alias("known"), "base", (mixed / float(LOG10)).alias("score"))

    # Words from a count on that keeps at most `head` of them; counts in 16ths of a doubling, so a bounded histogram.
    level = F.floor(F.log2("n") * 16).cast("int")
    steps = scored.groupBy(level.alias("level")).agg(F.count("*").alias("words")).toPandas().sort_values("level", ascending=False)
    fit = steps.level[steps.words.cumsum() <= head]
    least = int(fit.min()) if len(fit) else 1 << 20
    top = scored.where(level >= least).select("h", "known", "base", "score").toPandas().sort_values("h")
    common = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("h", "known", "base", "score")))
    end_c = float(ends)
    end_base = float(np.log10((end_c + 1) / (n + 1 * (v + 1))))
    end_score = math.log10(weight * ends / n) if ends else math.log10(weight)

    def sums(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        th, tk, tb, ts = common.value
        for batch in batches:
            train = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, data, offsets in tx.blocks(batch.column(2)):
                k = len(offsets) - 1
                words, h = word_hashes(data, offsets)
                text, w = words.text_of, h.view(np.int64)
                at = np.minimum(np.searchsorted(th, w), max(len(th) - 1, 0)) if len(th) else np.zeros(len(w), np.int64)
                hit = th[at] == w if len(th) else np.zeros(len(w), bool)
                put = lambda x: np.bincount(text[hit], x[at[hit]], k) if hit.any() else np.zeros(k)  # noqa: E731, B023
                ids = row + np.arange(k)
                row += k
                none = pa.nulls(k, pa.int64())
                cols = [pa.array(ids), batch.column(0).slice(lo, k), pa.array(~train[lo : lo + k]), none, pa.array(words.per_text + 1), pa.array(put(tk.astype(float)).astype(np.int64) + (end_c > 0)), pa.array(put(tb) + end_base), pa.array(put(ts) + end_score)]
                names = ["row", "doc_id", "held_out", "h", "n", "known", "base", "score"]
                yield pa.RecordBatch.from_arrays(cols, names)
                rare = np.flatnonzero(~hit)
                if len(rare):
                    key = pd.DataFrame({"text": text[rare], "h": w[rare]}).groupby(["text", "h"], sort=False).size().reset_index(name="n")
                    m = len(key)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[key.text.to_numpy()]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.array(key.h.to_numpy()), pa.array(key.n.to_numpy()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], names)

    rows = docs.select(F.col("doc_id").cast("long"), "train", F.col("text").cast("string")).mapInArrow(tx.lean(sums), "row bigint, doc_id bigint, held_out boolean, h bigint, n bigint, known bigint, base double, score double")
    rows = scratch.table(rows, "rows")
    tail = rows.where("h is not null").select("row", "h", F.col("n").alias("tf")).join(scored.where(level < least).select("h", F.col("known").cast("long").alias("k"), "base", "score"), "h")
    tail = tail.groupBy("row").agg(F.sum(F.col("tf") * F.col("k")).alias("k"), F.sum(F.col("tf") * F.col("base")).alias("b"), F.sum(F.col("tf") * F.col("score")).alias("s"))
    heads = rows.where("h is null").join(tail, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return heads.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + zero("k")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"),
    )


def score_documents(docs: DataFrame, scratch: Scratch, vocabulary: str) -> DataFrame:
    """The columns of the scoring contract."""
    train = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    return corpus_scores(docs.select("doc_id", F.coalesce(train, F.lit(True)).alias("train"), "text"), scratch, vocabulary)
