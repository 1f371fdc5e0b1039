"""N-gram Jaccard join of documents: rare-first prefix filtering, joined on prefix n-grams, verified once per pair.

Each document is its set of distinct five-word shingles, as 64-bit hashes. Equal sets collapse to
their smallest document first. Shingles are ordered rare first by a fixed-size table of their
frequencies in all documents (hash buckets, so the order is global whatever the corpus' size, ties by hash); two sets at
0.8 or more must share a shingle among the first n - ceil(0.8 n) + 1 of each.

Linked documents only have to end up in one component, and pairs inside a component can't change it. So
rounds of bounded size come first: each document on a shingle meets the few that have it earliest in their
order, as the original of a group of copies does, then a few next to it in a random order that changes
from round to round. Components are contracted after each. Last, every pair of documents of different components that share a prefix shingle is verified:
no round drops a pair, the earlier ones only leave few. Length and positional filters hold before
verification. Pairs that pass are compared by parity sketches, 2 to 4 bits a shingle: two sets differ in at
least as many shingles as their sketches do in bits, so what the sketches tell apart needs no
sets. The others' sets meet once a pair, a suffix filter (shingles counted by part of their range) first.

Edge cases: null, empty and wordless texts have an empty set, link with nothing and are their own
component; fewer than five words are one shingle; repeated rows share their set's component; very long texts are
worked on whole, one at a time; ties in the order don't matter, as any order gives the same components; an empty table
gives no rows. classes() reads doc_id and the text only, whatever other columns are called; keep_one() gives all
columns back as they were.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .components import components
from .runtime import Bitmap, Scratch, fan_out

SHINGLE = 5
#: Frequency buckets of the shingle order; fixed, 4 bytes each.
BUCKETS = 1 << 18
#: Slices in which tasks hand on their counts of shingles.
SLICES = 64
#: Neighbours that a document meets, in the first round and in later ones; documents that all on their shingle meet.
NEAR, HUBS = (2, 8), 2
#: A round that links more than one in so many open documents is followed by others.
FRUITFUL = 1000
#: Open shingles of a document that are carried to give each pair once.
LEADING = 16
#: A shingle in more documents than this is dealt to several tasks.
HOT = 20_000


def text_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct shingles of each text, by text and hash."""
    words = tx.Words(data, offsets)
    h, text = tx.shingles(words, words.hashes(), SHINGLE)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


def least_overlap(a: Column, b: Column) -> Column:
    """Smallest intersection of sets of a and b shingles at a similarity of 0.8."""
    return F.ceil((a + b) * 4 / 9)


def similar_lengths(a: Column, b: Column) -> Column:
    return (F.least(a, b) * 5 >= F.greatest(a, b) * 4)


def set_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n, s1, s2 (a 128-bit digest of its set) of each document; besides, with a slice, a task's counts of shingles in it."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        names = ["slice", "doc_id", "n", "s1", "s2", "counts"]
        for batch in batches:
            for lo, data, offsets in tx.blocks(batch.column(1)):
                k = len(offsets) - 1
                h, text = text_sets(data, offsets)
                counts += np.bincount((h >> np.uint64(46)).astype(np.int64), minlength=BUCKETS)
                n = np.bincount(text, minlength=k)
                ends = np.concatenate([[0], np.cumsum(n)])
                digests = []
                for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    sums = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(tx.mix(h ^ np.uint64(salt)), out=sums[1:])
                    digests.append(tx.signed(sums[ends[1:]] - sums[ends[:-1]]))
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), batch.column(0).slice(lo, k), pa.array(n), *map(pa.array, digests), pa.nulls(k, pa.binary())], names)
        if counts.any():
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), none, none, none, none, pa.array([x.tobytes() for x in counts.reshape(SLICES, -1)], pa.binary())], names)

    return docs.mapInArrow(tx.lean(run), "slice int, doc_id bigint, n bigint, s1 bigint, s2 bigint, counts binary")


def frequencies(rows: DataFrame, many: int) -> np.ndarray:
    """Documents of each bucket, from the slices of all tasks: summed by slice, then BUCKETS numbers to the driver."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])

    found = rows.where("slice is not null").select("slice", "counts").repartition(many, "slice").mapInArrow(run, "slice int, counts binary").toPandas()
    out = np.zeros((SLICES, BUCKETS // SLICES), np.int64)
    for k, raw in zip(found.slice, found.counts, strict=True):
        out[k] += np.frombuffer(raw, np.int64)
    return out.reshape(-1)


def prefix_postings(docs: DataFrame, frequency: np.ndarray, hot: int) -> DataFrame:
    """doc, n, and the prefix of each document's set as arrays of hashes and of parts among which a frequent shingle is dealt."""
    shared = docs.sparkSession.sparkContext.broadcast(frequency)

    def run(batches):
        for batch in batches:
            for lo, data, offsets in tx.blocks(batch.column(1)):
                k = len(offsets) - 1
                h, text = text_sets(data, offsets)
                f = shared.value[(h >> np.uint64(46)).astype(np.int64)]
                order = np.lexsort((h, f, text))
                h, f = h[order], f[order]
                n = np.bincount(text, minlength=k)
                first = np.cumsum(n) - n
                keep = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
                doc = np.repeat(np.arange(k), keep)
                pos = np.arange(keep.sum()) - np.repeat(np.cumsum(keep) - keep, keep)
                at = first[doc] + pos
                ends = pa.array(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32))
                parts = np.minimum(f[at] // hot + 1, 1 << 14).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, k), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(tx.signed(h[at]))), pa.ListArray.from_arrays(ends, pa.array(parts))], ["doc", "n", "prefix", "parts"])

    return docs.mapInArrow(tx.lean(run), "doc bigint, n bigint, prefix array<bigint>, parts array<int>")


def drop_lonely(sorted_postings: DataFrame) -> DataFrame:
    """Postings, sorted by h and dealt by (h, part), without those whose shingle no other document has. Streams; holds one row over."""
    schema = sorted_postings.schema

    def run(batches):
        carry: pa.RecordBatch | None = None
        same_before = False
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([carry, batch] if carry is not None else [batch]).combine_chunks().to_batches()[0]
            h = table.column(0).to_numpy(zero_copy_only=False)
            parts = table.column(4).to_numpy(zero_copy_only=False)
            equal = h[1:] == h[:-1]
            keep = parts > 1
            keep[1:] |= equal
            keep[:-1] |= equal
            keep[0] |= same_before
            m = len(h) - 1
            if m:
                yield table.slice(0, m).filter(pa.array(keep[:m]))
                same_before = bool(equal[-1])
            carry = table.slice(m)
        if carry is not None and (same_before or carry.column(4)[0].as_py() > 1):
            yield carry

    return sorted_postings.mapInArrow(tx.lean(run), schema)


def sketches(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, ends) of each set's parity sketch: bit h mod b is the parity of the hashes there, b the power of two from 2 n on."""
    words = 1 << np.maximum(np.ceil(np.log2(np.maximum(n, 1) / 32)), 0).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(words)])
    place = np.repeat(ends[:-1], n) * 64 + (h & (np.repeat(words, n) * 64 - 1).astype(np.uint64)).astype(np.int64)
    parity = np.zeros(ends[-1] * 64, np.uint8)
    place, times = np.unique(place, return_counts=True)
    parity[place] = times & 1
    return np.packbits(parity, bitorder="little").view(np.int64), ends.astype(np.int32)


def sets_of(docs: DataFrame, wanted: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(doc, n, sketch, hashes in unsigned order) of the documents in wanted (column doc), and of a few more that its bitmap lets through: nothing is shuffled."""

    def run(batches):
        for batch in batches:
            for lo, data, offsets in tx.blocks(batch.column(1)):
                k = len(offsets) - 1
                h, text = text_sets(data, offsets)
                n = np.bincount(text, minlength=k)
                bits, ends = sketches(h, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, k), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(bits)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(tx.signed(h)))], ["doc", "n", "sketch", "hashes"])

    likely = docs.where(Bitmap(wanted, "doc").has("doc_id"))
    return scratch.table(likely.mapInArrow(tx.lean(run), "doc bigint, n bigint, sketch array<bigint>, hashes array<bigint>"), name)


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) whose sketches leave room for 0.8. A sketch of twice the length is folded upon itself."""
    asked = Bitmap(pairs.select(F.explode(F.array("a", "b")).alias("doc")), "doc")
    sets = sets.where(asked.has("doc"))
    x = sets.select(F.col("doc").alias("a"), F.col("n").alias("xn"), F.col("sketch").alias("x"))
    y = sets.select(F.col("doc").alias("b"), F.col("n").alias("yn"), F.col("sketch").alias("y"))

    def folded(own: Column, other: Column) -> Column:
        half = F.size(other)
        return F.when(F.size(own) > half, F.zip_with(F.slice(own, F.lit(1), half), F.slice(own, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(own)

    apart = F.zip_with(folded(F.col("x"), F.col("y")), folded(F.col("y"), F.col("x")), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    n = F.col("xn") + F.col("yn")
    both = pairs.join(y, "b").join(x, "a")
    return both.where(F.aggregate(apart, F.lit(0), lambda s, v: s + v) <= n - 2 * least_overlap(F.col("xn"), F.col("yn"))).select("a", "b")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) that reach 0.8. Both sets meet in one row; a suffix filter on quarters of the hash range comes first.

    Only sets of the pairs' documents are shuffled; a bitmap of these holds the others back at the scan.
    """

    def run(batches):
        cuts = np.array([1 << 62, 1 << 63, 3 << 62], np.uint64)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            (xs, xe), (ys, ye) = ((c.values.to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in map(batch.column, ("x", "y")))
            for i in range(len(keep)):
                x, y = xs[xe[i] : xe[i + 1]], ys[ye[i] : ye[i + 1]]
                need = -(-4 * (len(x) + len(y)) // 9)
                p, q = np.diff([0, *np.searchsorted(x, cuts), len(x)]), np.diff([0, *np.searchsorted(y, cuts), len(y)])
                if np.minimum(p, q).sum() >= need:
                    both = np.concatenate([x, y])
                    both.sort()
                    keep[i] = (both[1:] == both[:-1]).sum() >= need
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    asked = Bitmap(pairs.select(F.explode(F.array("a", "b")).alias("doc")), "doc")
    sets = sets.where(asked.has("doc")).select("doc", "hashes")
    x = sets.select(F.col("doc").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("doc").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(y, "b").join(x, "a").mapInArrow(tx.lean(run), "a bigint, b bigint")


def may_link(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Length and positional filter: whether sets of n and m shingles can reach 0.8 if their first common one stands at pos and at."""
    return similar_lengths(n, m) & (F.least(n - pos, m - at) >= least_overlap(n, m))


def neighbours(rows: DataFrame, reach: int, step: int, many: int, mixed: bool = False) -> DataFrame:
    """Pairs (a, b) of rows (h, doc, n, pos, parts, c) with one shingle and two components that stand at most `reach` apart in a random order of the shingle's documents.

    The order is the same on all shingles, so documents that share many meet few others; mixed, it is another on each.
    """

    def run(batches):
        carry: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            old = carry.num_rows if carry is not None else 0
            table = pa.Table.from_batches([carry, batch] if old else [batch]).combine_chunks().to_batches()[0]
            h, part, doc, n, pos, c = (table.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            found = []
            for q in range(1, min(reach, len(h) - 1) + 1):
                i = np.arange(max(0, old - q), len(h) - q)
                j = i + q
                a, b, rest = n[i].astype(np.int64), n[j].astype(np.int64), np.minimum(n[i] - pos[i], n[j] - pos[j])
                ok = (h[i] == h[j]) & (part[i] == part[j]) & (c[i] != c[j]) & (np.minimum(a, b) * 5 >= np.maximum(a, b) * 4) & (rest * 9 >= (a + b) * 4)
                found.append(np.stack([np.minimum(doc[i], doc[j])[ok], np.maximum(doc[i], doc[j])[ok]]))
            if found:
                a, b = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            carry = table.slice(max(0, len(h) - reach))

    dealt = rows.select("h", F.pmod(F.xxhash64("doc", F.lit(step)), F.col("parts")).cast("int").alias("part"), "doc", "n", "pos", "c", F.xxhash64("doc", F.lit(~step), *(["h"] if mixed else [])).alias("o"))
    ordered = dealt.repartition(many, "h", "part").sortWithinPartitions("h", "part", "o")
    return ordered.drop("o").mapInArrow(tx.lean(run), "a bigint, b bigint")


def hub_pairs(rows: DataFrame, step: int) -> DataFrame:
    """Pairs (a, b) of rows with HUBS documents of their shingle, those that have the fewest shingles before it: one of each residue class of ids."""
    own = F.struct(F.col("pos").alias("yp"), F.col("n").alias("yn"), F.col("doc").alias("y"), F.col("c").alias("yc"))
    of = F.pmod(F.xxhash64("doc", F.lit(step)), F.lit(HUBS))
    best = rows.groupBy("h").agg(*(F.min(F.when(of == k, own)).alias(f"hub{k}") for k in range(HUBS)))
    best = best.select("h", F.explode(F.array_compact(F.array(*(f"hub{k}" for k in range(HUBS))))).alias("hub")).select("h", "hub.*")
    met = rows.join(best, "h").where((F.col("c") != F.col("yc")) & may_link(F.col("n"), F.col("pos"), F.col("yn"), F.col("yp")))
    return met.select(F.least("doc", "y").alias("a"), F.greatest("doc", "y").alias("b"))


def cross_pairs(rows: DataFrame) -> DataFrame:
    """Every pair of rows (h, doc, n, pos, c) that share a shingle and not a component, nearly always once.

    The largest component of a shingle never meets itself: one side has the others only. A pair with a common shingle
    among the first LEADING of both comes from the earliest such one only.
    """
    sizes = rows.groupBy("h", "c").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("h").agg(F.max(F.struct("m", "c")).alias("top")).select("h", F.col("top.c").alias("top"))
    lead = rows.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("l")).select("doc", F.slice(F.transform("l", lambda x: x["h"]), 1, LEADING).alias("lead"))
    rows = rows.join(lead, "doc").join(largest, "h")
    one = rows.where("c <> top")
    other = rows.select("h", F.col("doc").alias("y"), F.col("n").alias("yn"), F.col("pos").alias("yp"), F.col("c").alias("yc"), F.col("lead").alias("ylead"), F.col("top").alias("ytop"))
    common = F.array_intersect("lead", "ylead")
    pairs = one.join(other, "h").where(
        (F.col("c") != F.col("yc"))
        & ((F.col("yc") == F.col("ytop")) | (F.col("doc") < F.col("y")))
        & may_link(F.col("n"), F.col("pos"), F.col("yn"), F.col("yp"))
        & ((F.size(common) == 0) | (F.get(common, F.lit(0)) == F.col("h")))
    )
    return pairs.select(F.least("doc", "y").alias("a"), F.greatest("doc", "y").alias("b"))


def joined_labels(label: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """label (id, component) after more links (a, b). Only links between components are worked on, each pair of components once."""
    old = label.select(F.col("id"), F.col("component"))
    edges = links.join(old.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(old.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    edges = edges.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    more = components(edges, scratch, name)
    moved = old.join(more.select(F.col("id").alias("component"), F.col("component").alias("c")), "component", "left").select("id", F.coalesce("c", "component").alias("component"))
    return moved.unionByName(more)


class Search:
    """Components of the documents on postings, and the links that made them, as rounds go on."""

    def __init__(self, docs: DataFrame, postings: DataFrame, scratch: Scratch, many: int):
        self.postings, self.scratch, self.many, self.step = postings, scratch, many, 0
        wanted = scratch.table(postings.select("doc").distinct(), "wanted")
        self.open = wanted.count()
        self.sets = sets_of(docs, wanted, scratch, "sets")
        self.label: DataFrame | None = None
        self.tried: list[DataFrame] = []

    def rows(self) -> DataFrame:
        """The postings with their documents' components, of shingles that have more than one."""
        if self.label is None:
            return self.postings.withColumn("c", F.col("doc"))
        return self.postings.join(self.label, F.col("doc") == F.col("id"), "left").select(*self.postings.columns, F.coalesce("component", "doc").alias("c"))

    def round(self, pairs: DataFrame) -> int:
        """Verify the pairs that weren't tried before, contract what they link; how many links there were."""
        pairs = pairs.distinct()
        for old in self.tried:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = self.scratch.table(pairs, f"pairs-{self.step}")
        close = self.scratch.table(plausible(pairs, self.sets), f"close-{self.step}")
        found = self.scratch.table(verify(close, self.sets), f"links-{self.step}")
        self.scratch.drop(f"close-{self.step}")
        self.tried.append(pairs)
        n = found.count()
        if n:
            before = self.label if self.label is not None else found.limit(0).select(F.col("a").alias("id"), F.col("b").alias("component"))
            self.label = self.scratch.table(joined_labels(before, found, self.scratch, f"edges-{self.step}"), f"labels-{self.step}")
        self.step += 1
        return n

    def near(self, reach: int, mixed: bool = False) -> int:
        return self.round(neighbours(self.rows(), reach, self.step, self.many, mixed))

    def hubs(self) -> int:
        return self.round(hub_pairs(self.rows(), self.step))

    def rest(self) -> int:
        """All pairs that are left."""
        rows = self.rows()
        many = rows.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("h")
        return self.round(cross_pairs(rows.join(many, "h", "left_semi")))


def classes(docs: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    many = fan_out(docs.sparkSession)
    rows = scratch.table(set_rows(docs), "rows")
    frequency = frequencies(rows, many)
    every = rows.where("slice is null").select("doc_id", "n", "s1", "s2")
    reps = scratch.table(every.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")), "reps")

    # Buckets hold the average of all shingles besides; what stands above it is one shingle's own.
    hot = int(HOT + frequency.mean() + 6 * np.sqrt(frequency.mean()))
    # Documents that surely aren't copies stay where they are; only those that may be are looked up.
    copies = every.join(reps, ["n", "s1", "s2"]).where("doc_id <> rep").select("doc_id")
    maybe = Bitmap(copies, "doc_id")
    sure, doubtful = (prefix_postings(docs.where(x), frequency, hot) for x in (~maybe.has("doc_id"), maybe.has("doc_id")))
    prefixes = sure.unionByName(doubtful.join(reps.select(F.col("rep").alias("doc")), "doc", "left_semi"))
    postings = prefixes.select("doc", "n", F.posexplode(F.arrays_zip("prefix", "parts")).alias("pos", "x"))
    postings = postings.select(F.col("x.prefix").alias("h"), "doc", F.col("n").cast("int").alias("n"), F.col("pos").cast("int").alias("pos"), F.col("x.parts").alias("parts"))
    dealt = postings.repartition(many, "h", F.pmod(F.xxhash64("doc"), F.col("parts"))).sortWithinPartitions("h")
    search = Search(docs, scratch.table(drop_lonely(dealt), "postings"), scratch, many)
    search.hubs()
    linked = search.near(NEAR[0])
    while linked * FRUITFUL > search.open:
        linked = search.near(NEAR[1], mixed=True) + search.hubs()
    search.rest()

    label = search.label if search.label is not None else reps.limit(0).select(F.col("rep").alias("id"), F.col("rep").alias("component"))
    comp = reps.join(label, F.col("rep") == F.col("id"), "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("c"))
    return every.join(comp, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with one document, the smallest, of each component; of rows with one id, one stays.

    Only documents that may have to go are joined: a bitmap lets the others pass where they are.
    """
    found = scratch.table(classes(docs, scratch), "classes")
    again = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("c")).where("n > 1 or doc_id <> c")
    doubtful = scratch.table(again.select(F.col("doc_id").alias("id"), F.expr("doc_id <> c").alias("goes")), "doubtful")
    bitmap = Bitmap(doubtful, "id")
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    held = whole.where(bitmap.has("id")).join(doubtful, "id", "left").where(~F.coalesce("goes", F.lit(False)))
    once = held.where("goes is not null").dropDuplicates(["id"])
    return whole.where(~bitmap.has("id")).select("row.*").unionByName(held.where("goes is null").select("row.*")).unionByName(once.select("row.*"))
