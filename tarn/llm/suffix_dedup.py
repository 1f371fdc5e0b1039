"""Removal of repeated byte strings by per-shard suffix arrays.

Every byte covered by a string of SPAN bytes that starts anywhere else in the corpus too is removed.

1. Sampling. Of the GRAM-byte hashes in each SPAN-byte window one is the least: the window's anchor.
   Equal windows have equal anchors, so windows whose anchor occurs once in the corpus need no sorting.
2. Sharding. What is left is the contexts of repeated anchors: the bytes that any window through the
   anchor can cover. Equal contexts of an anchor are one, with a count. Contexts are dealt
   by anchor, and a frequent anchor's among several shards.
3. Suffix arrays. A shard sorts all suffixes of its contexts by Larsson-Sadakane refinement in numpy
   (ranks by 8 bytes, doubled, unsorted groups only) and gets common prefixes by Kasai's scan, run in
   lockstep over the contexts. Neighbours with a common prefix of SPAN bytes are repeated windows.
4. Merging. Shards of a split anchor merge their distinct windows by binary search of sorted digests.

Edge cases: null and empty texts keep nothing and lose nothing; texts below SPAN bytes never match;
matches may overlap themselves in one text; equal rows repeat each other; an empty table gives no rows; a long text is
read whole, one at a time; ties (equal windows) are all repeated. Only doc_id and the text are read, whatever other
columns are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .runtime import Bitmap, Scratch, fan_out

SPAN, GRAM = 200, 64
#: Gram positions in a window, and bytes of a window that can stand before or behind its anchor's start.
PLACES = SPAN - GRAM + 1
#: Bytes of contexts in one suffix array; contexts of one anchor in one shard.
SHARD_BYTES, SHARD_CONTEXTS = 3 << 18, 2_000
_LOW = np.uint64((1 << 24) - 1)
_BYTES = np.array([1 << (8 * k) for k in range(8)], np.uint64)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row, by two accumulations over blocks of w."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    pad = -len(v) % w
    blocks = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Of a block: text, place in it, anchor hash, context hash, bytes of context before and from the anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none, none, none, none, none
    spans = tx.SpanHash(tx.byte_values(data))
    grams = spans.windows(GRAM)
    keyed = (grams & ~_LOW) | (np.arange(len(grams), dtype=np.uint64) & _LOW)
    least = sliding_min(keyed, PLACES)
    start = np.arange(len(least))
    text = np.searchsorted(offsets, start, "right") - 1
    inside = start + SPAN <= offsets[text + 1]
    start, text, least = start[inside], text[inside], least[inside]
    at = start + ((least - start.astype(np.uint64)) & _LOW).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    at, text = at[new], text[new]
    lo, hi = np.maximum(offsets[text], at - (SPAN - GRAM)), np.minimum(offsets[text + 1], at + SPAN)
    context = tx.mix(spans(lo, hi) + (at - lo).astype(np.uint64))
    return text, at - offsets[text], tx.signed(grams[at]), tx.signed(context), at - lo, hi - at


def suffix_order(data: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in data that `window` marks, in the order of the 256 bytes from there; whether each equals the
    one before it in all of them; the first 8 bytes of each place of data as a number). A marked place has SPAN bytes after it.

    Larsson and Sadakane's refinement: suffixes are ranked by their first 8 bytes, then groups of equal
    rank are sorted by the rank of what follows, twice as deep each time, groups of one no more. The last doubling
    is for the marked places only.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(word)
    key = word[order]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), np.int32(0)))
    h = 8
    while h < 128:
        single = head.copy()
        single[:-1] &= head[1:]
        todo = np.flatnonzero(~single)  # places of the order in unsorted groups
        if not len(todo):
            break
        at = order[todo]
        key = (rank[at].astype(np.int64) << 32) | (rank[np.minimum(at + h, n)] + 1)
        sub = np.argsort(key)
        at, key = at[sub], key[sub]
        order[todo] = at
        new = np.ones(len(todo), bool)
        new[1:] = key[1:] != key[:-1]
        head[todo] = new
        rank[at] = np.maximum.accumulate(np.where(new, todo, 0))
        h *= 2
    at = np.flatnonzero(window)
    key = (rank[at].astype(np.int64) << 32) | (rank[np.minimum(at + 128, n)] + 1)
    sub = np.argsort(key)
    key = key[sub]
    same = np.zeros(len(at), bool)
    same[1:] = key[1:] == key[:-1]
    return at[sub], same, word


def common_prefixes(ordered: np.ndarray, same: np.ndarray, word: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Common prefix, up to SPAN, of each place of `ordered` with the one before it.

    Kasai's scan: the prefix of the next place of a text is at most one byte shorter, if the neighbour's next
    place is marked too and the two weren't tied. All texts go in lockstep, 8 bytes a comparison; starts and sizes: the
    first marked place of each text and how many follow in a row. Tied neighbours have SPAN bytes in common.
    """
    place = np.full(len(word) + 1, -1, np.int64)
    place[ordered] = np.arange(len(ordered))
    out = np.zeros(len(ordered), np.int64)
    by = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by], sizes[by]
    h = np.zeros(len(starts), np.int64)
    for t in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -t, "left"))  # texts with more than t places come first
        i = starts[:m] + t
        p = place[i]
        j = ordered[np.maximum(p - 1, 0)]
        tied = same[p]
        g = np.maximum(h[:m] - 1, 0)
        going = np.flatnonzero((p > 0) & ~tied)
        g[p == 0] = 0
        while len(going):
            # Words start SPAN - 8 bytes on at the latest: every marked place has as many.
            step = np.minimum(g[going], SPAN - 8)
            equal = 8 - np.searchsorted(_BYTES, word[i[going] + step] ^ word[j[going] + step], "right")
            g[going] = step + equal
            going = going[(equal == 8) & (g[going] < SPAN)]
        g[tied] = SPAN
        out[p] = g
        h[:m] = np.where(tied | (place[j + 1] < 0), 0, g)
    return out


def repeated_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: np.ndarray, sure: np.ndarray):
    """(windows in suffix order, run of each, whether each run is repeated): windows by start in data.

    ids: a number of the corpus position of each text's first byte; sure: texts that occur twice anyway.
    """
    owner = np.repeat(np.arange(len(starts)), ends - starts)
    window = ends[owner] - np.arange(len(data)) >= SPAN
    ordered, same, word = suffix_order(data, window)
    common = common_prefixes(ordered, same, word, starts, np.maximum(ends - starts - SPAN + 1, 0))
    run = np.cumsum(common < SPAN) - 1
    first = np.flatnonzero(common < SPAN)
    if not len(first):
        return ordered, run, np.zeros(0, bool)
    owner = owner[ordered]
    identity = ids[owner] + (ordered - starts[owner])
    low, high = np.minimum.reduceat(identity, first), np.maximum.reduceat(identity, first)
    return ordered, run, (low != high) | np.logical_or.reduceat(sure[owner], first)


def _identity(k: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Numbers of corpus positions: equal ones only for the same byte of the same text."""
    return (tx.mix(k.view(np.uint64)) >> np.uint64(2)).view(np.int64) + start


def shard_windows(contexts: DataFrame, many: int) -> DataFrame:
    """contexts (anchor, part, parts, k, pos, lead, c, bytes) -> kind 0: (k, first, last) window starts found repeated; kind 1: (d1, d2, k, first, shard) of the windows of split anchors."""
    names = ["kind", "k", "first", "last", "d1", "d2", "done"]

    def shard(f: pd.DataFrame):
        raw = f["bytes"].tolist()
        data, offsets = tx.utf8(pa.array(raw, pa.binary()))
        starts, ends = offsets[:-1], offsets[1:]
        k, begin = f.k.to_numpy(np.int64), (f.pos - f.lead).to_numpy(np.int64)
        sure = f.c.to_numpy() > 1
        at, run, repeated = repeated_windows(data, starts, ends, _identity(k, begin), sure)
        owner = np.searchsorted(ends, at, "right")
        hit = repeated[run] & ~sure[owner]
        o = np.argsort(at[hit])
        own, place = owner[hit][o], at[hit][o]
        s = begin[own] + place - starts[own]
        edge = np.ones(len(s), bool)
        edge[1:] = (own[1:] != own[:-1]) | (s[1:] != s[:-1] + 1)
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(s)) - 1 if len(first) else first
        z = np.zeros(len(first), np.int64)
        yield pd.DataFrame({"kind": z, "k": k[own[first]], "first": s[first], "last": s[last], "d1": z, "d2": z, "done": z})
        split = f.parts.to_numpy() > 1
        if split.any():
            # One window of each run of a split anchor: all those not repeated here, and one for the others to find.
            _, pick = np.unique(run[split[owner]], return_index=True)
            chosen = np.flatnonzero(split[owner])[pick]
            w, own = at[chosen], owner[chosen]
            spans = tx.SpanHash(tx.byte_values(data))
            again = tx.SpanHash(tx.mix(tx.byte_values(data) + np.uint64(77)))
            s = begin[own] + w - starts[own]
            yield pd.DataFrame({"kind": 1, "k": k[own], "first": s, "last": s, "d1": tx.signed(spans(w, w + SPAN)), "d2": tx.signed(again(w, w + SPAN)), "done": (repeated[run[chosen]] | sure[own]).astype(np.int64)})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            f = batch.to_pandas()
            length = f["bytes"].str.len().to_numpy()
            change = np.append(True, (f.anchor.to_numpy()[1:] != f.anchor.to_numpy()[:-1]) | (f.part.to_numpy()[1:] != f.part.to_numpy()[:-1]))
            if held and len(f) and (held[-1].anchor.iloc[-1], held[-1].part.iloc[-1]) == (f.anchor.iloc[0], f.part.iloc[0]):
                change[0] = False
            lo = 0
            for cut in np.flatnonzero(change):
                if size + length[lo:cut].sum() >= SHARD_BYTES:
                    held.append(f.iloc[lo:cut])
                    yield from arrow(pd.concat(held))
                    held, size, lo = [], 0, cut
            held.append(f.iloc[lo:])
            size += length[lo:].sum()
        if held:
            yield from arrow(pd.concat(held))

    def arrow(f: pd.DataFrame):
        if len(f):
            for part in shard(f):
                if len(part):
                    yield pa.RecordBatch.from_pandas(part[names].astype("int64"), preserve_index=False)

    dealt = contexts.repartition(many, "anchor", "part").sortWithinPartitions("anchor", "part")
    return dealt.mapInArrow(tx.lean(run), ", ".join(f"{n} bigint" for n in names))


def merge_shards(windows: DataFrame, many: int) -> DataFrame:
    """(k, first, last) of windows, one of each run of a shard, that another shard has too: digests are sorted and each is searched among all."""

    def run(batches):
        carry = None
        for batch in batches:
            table = pa.Table.from_batches([carry, batch] if carry is not None else [batch])
            f = table.to_pandas()
            if not len(f):
                continue
            last = (f.d1.iloc[-1], f.d2.iloc[-1])
            open_ = ((f.d1 == last[0]) & (f.d2 == last[1])).to_numpy()
            carry = pa.RecordBatch.from_pandas(f[open_], preserve_index=False)
            yield from found(f[~open_])
        if carry is not None:
            yield from found(carry.to_pandas())

    def found(f: pd.DataFrame):
        if not len(f):
            return
        key = tx.mix(f.d1.to_numpy().view(np.uint64)) ^ f.d2.to_numpy().view(np.uint64)
        ordered = np.sort(key)
        many_ = np.searchsorted(ordered, key, "right") - np.searchsorted(ordered, key, "left") > 1
        # The same corpus position may stand in contexts of two shards: it repeats only if there is another.
        ids = _identity(f.k.to_numpy(), f["first"].to_numpy())
        g = pd.DataFrame({"key": key, "id": ids}).groupby("key").id
        other = (g.transform("min") != g.transform("max")).to_numpy()
        anyone = pd.Series(f.done.to_numpy()).groupby(key).transform("max").to_numpy() > 0
        hit = many_ & (other | anyone)
        if hit.any():
            yield pa.RecordBatch.from_pandas(f.loc[hit, ["k", "first", "last"]], preserve_index=False)

    dealt = windows.select("k", "first", "last", "d1", "d2", "done").repartition(many, "d1").sortWithinPartitions("d1", "d2")
    return dealt.mapInArrow(tx.lean(run), "k bigint, first bigint, last bigint")


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, spans array<struct<first, last>>) of the window starts repeated elsewhere, of docs (k, text)."""
    spark = docs.sparkSession
    many = fan_out(spark)

    def sample(batches):
        for batch in batches:
            for lo, data, offsets in tx.blocks(batch.column(1)):
                text, pos, anchor, context, lead, rest = anchors(data, offsets)
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(context), batch.column(0).take(pa.array(lo + text)), pa.array(pos.astype(np.int32)), pa.array(lead.astype(np.int16)), pa.array(rest.astype(np.int16))], ["anchor", "context", "k", "pos", "lead", "rest"])

    sampled = scratch.table(docs.mapInArrow(tx.lean(sample), "anchor bigint, context bigint, k bigint, pos int, lead short, rest short"), "anchors")
    twice = sampled.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    kept = scratch.table(sampled.join(twice, "anchor", "left_semi"), "repeated")
    scratch.drop("anchors")
    groups = kept.groupBy("anchor", "context").agg(F.count("*").alias("c"), F.min(F.struct("k", "pos", "lead", "rest")).alias("r"))
    per = groups.groupBy("anchor").agg(F.count("*").alias("contexts"))
    groups = scratch.table(groups.join(per, "anchor"), "groups")

    copies = kept.join(groups.where("c > 1").select("anchor", "context"), ["anchor", "context"], "left_semi")
    copies = copies.select("k", (F.col("pos") - F.col("lead")).cast("long").alias("first"), (F.col("pos") + F.col("rest") - SPAN).cast("long").alias("last"))

    asked = groups.where("contexts > 1").select("anchor", "context", "c", "contexts", "r.*")
    bitmap = Bitmap(asked, "k")
    wanted = asked.groupBy("k").agg(F.collect_list(F.struct("anchor", "context", "c", "contexts", "pos", "lead", "rest")).alias("asks"))

    def cut(batches):
        for batch in batches:
            k, texts, asks = batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2)
            owner = np.repeat(np.arange(len(k)), np.diff(asks.offsets.to_numpy()))
            flat = asks.flatten()
            col = {n: flat.field(n).to_numpy(zero_copy_only=False) for n in ("anchor", "context", "c", "contexts", "pos", "lead", "rest")}
            for lo in range(0, len(owner), 20_000):
                sl = slice(lo, lo + 20_000)
                raw, before = [], -1
                for o, p, a, b in zip(owner[sl], col["pos"][sl], col["lead"][sl], col["rest"][sl], strict=True):
                    if o != before:
                        text, before = texts[int(o)].as_py(), o
                    raw.append(text[p - a : p + b])
                parts = -(-col["contexts"][sl] // SHARD_CONTEXTS)
                part = (tx.mix(col["context"][sl].view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(col["anchor"][sl]), pa.array(part), pa.array(parts), k.take(pa.array(owner[sl])), pa.array(col["pos"][sl].astype(np.int64)), pa.array(col["lead"][sl].astype(np.int64)), pa.array(col["c"][sl]), pa.array(raw, pa.binary())], ["anchor", "part", "parts", "k", "pos", "lead", "c", "bytes"])

    likely = docs.where(bitmap.has("k"))
    contexts = likely.dropDuplicates(["k"]).join(wanted, "k").select("k", "text", "asks").mapInArrow(tx.lean(cut), "anchor bigint, part bigint, parts bigint, k bigint, pos bigint, lead bigint, c bigint, bytes binary")
    found = scratch.table(shard_windows(contexts, many), "windows")
    apart = merge_shards(found.where("kind = 1"), many)
    marks = copies.unionByName(found.where("kind = 0").select("k", "first", "last")).unionByName(apart)
    return scratch.table(marks.groupBy("k").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "marks")


def covered(size: int, spans: np.ndarray) -> np.ndarray:
    """Bytes of a text covered by windows that start in any of the spans."""
    edges = np.zeros(size + 1, np.int32)
    np.add.at(edges, spans[:, 0], 1)
    np.add.at(edges, np.minimum(spans[:, 1] + SPAN, size), -1)
    return np.cumsum(edges[:size]) > 0


def removed(docs: DataFrame, scratch: Scratch, text: str = "text", kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, where asked for, kept (bytes) of each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("k"), "text", "doc_id")
    marks = repeated_spans(keyed.select("k", "text"), scratch)
    bitmap = Bitmap(marks, "k")

    def apply(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            spans = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
            rows = []
            for t, s in zip(texts.to_pylist(), spans, strict=True):
                raw, gone, runs = t, 0, 0
                if s:
                    mask = covered(len(t), np.array([(x["first"], x["last"]) for x in s], np.int64))
                    gone, runs = int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    raw = np.frombuffer(t, np.uint8)[~mask].tobytes()
                rows.append((len(t), gone, runs, hashlib.sha256(raw).hexdigest(), raw if kept else None))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), kind) for c, kind in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    clean = keyed.where(~bitmap.has("k")).select("doc_id", "text").mapInArrow(tx.lean(apply), schema)
    marked = keyed.where(bitmap.has("k")).join(marks, "k", "left").select("doc_id", "text", "spans").mapInArrow(tx.lean(apply), schema)
    return clean.unionByName(marked)


def digest(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The columns of the removal contract."""
    return removed(docs, scratch, kept=False).drop("kept")
