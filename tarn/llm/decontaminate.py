"""Benchmark decontamination by SimHash windows.

A benchmark item of m words is compared with windows of m words of every document. A window's
64-bit SimHash is the sign of each bit's weighted sum over its shingles; windows of one document
come from one running sum. A multi-index finds the items within RADIUS bits: fingerprints are cut
into BLOCKS blocks, and by the pigeonhole principle two within RADIUS agree in at least one block
up to RADIUS // BLOCKS bits, so no fingerprint within the radius is missed. RADIUS is wide enough for
what LEAST asks (a test measures it on windows of 5 to 400 shingles); with it most windows
that share a shingle with an item are candidates, so the index saves little of the verification. Candidates
are verified by the exact weighted Jaccard similarity of their five-word shingles (weight: how often each occurs).

Windows without any shingle of an item of their size have similarity 0 with all of them; only the
others are fingerprinted. Words are runs of letters, digits and bytes beyond ASCII, ASCII case folded.

The benchmark is read in blocks of at most MOST_SHINGLES shingles, each broadcast; more blocks mean
more passes over the documents, never a larger broadcast.

Edge cases: null and empty texts, and items without words, match nothing; a text shorter than an
item is one window, all of it; repeated rows each get their matches; equal similarities keep the first window;
an empty table on either side gives no matches; texts of any length are read whole, one at a time. leaks() reads
doc_id and text only; clean() gives all columns back, whatever they are called.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .runtime import ship

SHINGLE, LEAST, RADIUS, BLOCKS = 5, 0.8, 23, 8
MOST_SHINGLES = 500_000
NOT_WORD = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def bits(h: np.ndarray) -> np.ndarray:
    """The bits of each hash as +1 and -1."""
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash, as rows of 8 bytes, of the runs of sizes[i] shingles from starts[i]."""
    sums = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(bits(h), axis=0, out=sums[1:])
    return np.packbits(sums[starts + sizes] - sums[starts] > 0, axis=1)


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


class Items:
    """Items of one number of words: a multi-index of their fingerprints."""

    def __init__(self, ids: list[int], shingles: list[np.ndarray]):
        self.ids = np.array(ids)
        self.counts = [Counter(s.tolist()) for s in shingles]
        self.prints = np.concatenate([fingerprints(s, np.array([0]), np.array([len(s)])) for s in shingles])
        near = _POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // BLOCKS
        #: For each block and value of it, the items near it in that block.
        self.index = np.stack([near[:, self.prints[:, b]] for b in range(BLOCKS)])

    def candidates(self, prints: np.ndarray) -> np.ndarray:
        """(window, item) pairs within RADIUS."""
        some = np.zeros((len(prints), len(self.ids)), bool)
        for b in range(BLOCKS):
            some |= self.index[b, prints[:, b]]
        w, i = np.nonzero(some)
        close = _POPCOUNT[prints[w] ^ self.prints[i]].sum(axis=1) <= RADIUS
        return np.stack([w[close], i[close]], axis=1)


class Benchmark:
    def __init__(self, rows: list[tuple[int, str]]):
        texts = [(int(i), t) for i, t in rows if i is not None and t]
        data, offsets = tx.utf8(pa.array([t for _, t in texts], pa.string()))
        words = tx.Words(data, offsets, NOT_WORD)
        h, of = tx.shingles(words, words.hashes(), SHINGLE)
        by_size: dict[int, list] = defaultdict(list)
        sizes_of: dict[int, set] = defaultdict(set)
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
        for k in np.flatnonzero(words.per_text):
            own, m = h[of == k], int(words.per_text[k])
            by_size[m].append((texts[k][0], own))
            for x in own.tolist():
                sizes_of[x].add(m)
        self.sizes = {m: Items([i for i, _ in x], [s for _, s in x]) for m, x in by_size.items()}
        self.short = sorted(m for m in by_size if m < SHINGLE)
        self.known = np.sort(np.array(list(sizes_of), np.uint64))
        self.sizes_of = sizes_of

    def matches(self, data: np.ndarray, offsets: np.ndarray):
        """Yield (text, item id, similarity, first word, words) of each text and item that meet LEAST."""
        words = tx.Words(data, offsets, NOT_WORD)
        hashes = words.hashes()
        n = len(hashes)
        if not n or not len(self.known):
            return
        # The shingle that starts at each word; a text of fewer than SHINGLE words has one, of all of it.
        whole = tx.SpanHash(hashes, tx._C)
        text = words.text_of
        stop = np.minimum(np.arange(n) + SHINGLE, words.bounds[text + 1])
        h = whole(np.arange(n), stop)
        full = stop - np.arange(n) == SHINGLE
        first = np.arange(n) == words.bounds[text]
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hits = np.flatnonzero((self.known[at] == h) & (full | first))
        found: dict[tuple[int, int], tuple] = {}
        for m in self.short:  # items of fewer than SHINGLE words are one shingle of m words
            items = self.sizes[m]
            g = whole(np.arange(max(n - m + 1, 0)), np.arange(max(n - m + 1, 0)) + m)
            keys = {next(iter(c)): i for i, c in zip(items.ids, items.counts, strict=True)}
            for p in np.flatnonzero(np.isin(g, np.array(list(keys), np.uint64))):
                if text[p] == text[p + m - 1]:
                    for i, c in zip(items.ids, items.counts, strict=True):
                        if int(g[p]) in c:
                            found.setdefault((int(text[p]), int(i)), (1.0, int(p - words.bounds[text[p]]), m))
        todo: dict[tuple[int, int], set] = defaultdict(set)
        for p in hits.tolist():
            for m in self.sizes_of[int(h[p])]:
                t = int(text[p])
                lo, hi = int(words.bounds[t]), int(words.bounds[t + 1])
                if m >= SHINGLE:
                    last = max(lo, hi - m)
                    todo[t, m].update(range(max(lo, p - m + SHINGLE), min(p, last) + 1) or [last])
        for (t, m), starts in todo.items():
            lo, hi = int(words.bounds[t]), int(words.bounds[t + 1])
            s = np.array(sorted(starts))
            runs = np.maximum(np.minimum(s + m, hi) - s - SHINGLE + 1, 1)
            base = int(s[0])
            own = h[base : int((s + runs).max())]
            items = self.sizes[m]
            pairs = items.candidates(fingerprints(own, s - base, runs))
            counts: dict[int, Counter] = {}
            for w, i in pairs.tolist():
                if w not in counts:
                    counts[w] = Counter(h[s[w] : s[w] + runs[w]].tolist())
                similar = weighted_jaccard(counts[w], items.counts[i])
                if similar >= LEAST:
                    key, new = (t, int(items.ids[i])), (similar, int(s[w]) - lo, int(min(m, hi - s[w])))
                    if key not in found or (found[key][0], -found[key][1]) < (new[0], -new[1]):
                        found[key] = new
        for (t, i), x in sorted(found.items()):
            yield t, i, *x


MATCH = "doc_id bigint, item_id bigint, similarity double, start_word bigint, n_words bigint"


def blocks_of(benchmark: DataFrame, most_shingles: int = MOST_SHINGLES):
    """Broadcasts of the benchmark, a block of items after another."""
    spark = benchmark.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null")
    # A block of items has about half of most_shingles words, which bounds its shingles.
    total = items.agg(F.sum(F.greatest(F.size(F.split("text", r"\W+")), F.lit(1)))).first()[0] or 0
    many = max(1, -(-total * 2 // most_shingles))
    for k in range(many):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(many)) == k).collect()
        yield spark.sparkContext.broadcast(Benchmark([tuple(r) for r in sorted(rows, key=lambda r: r[0])]))


def leaks(docs: DataFrame, benchmark: DataFrame, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """A row per document and item that meet LEAST: the most similar window."""
    out = None
    for shared in blocks_of(benchmark, most_shingles):

        def run(batches, shared=shared):
            for batch in batches:
                for lo, data, offsets in tx.blocks(batch.column(1)):
                    rows = [(batch.column(0)[lo + t].as_py(), *x) for t, *x in shared.value.matches(data, offsets)]
                    if rows:
                        cols = list(zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i == 2 else pa.int64()) for i, c in enumerate(cols)], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tx.lean(run), MATCH)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """docs without those that hold an item. Each row is decided where it is: no shuffle."""
    at = docs.columns.index(text)
    for shared in blocks_of(benchmark, most_shingles):

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, data, offsets in tx.blocks(batch.column(at).cast(pa.string())):
                    keep[[lo + t for t, *_ in shared.value.matches(data, offsets)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tx.lean(run), docs.schema)
    return docs
