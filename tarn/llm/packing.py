"""Vector bin packing of tokenised documents into training sequences.

A document's ids are cut into pieces of at most `tokens`; full pieces are sequences of their own.
The rests are placed under simultaneous limits on tokens, segments and loss-bearing tokens: an open
sequence takes, among the pieces that fit all its remaining limits, the one whose size vector has
the largest dot product with them. Pieces of one size are interchangeable, so the choice is among
size classes, not pieces. Rests are dealt to as many bins of work as the corpus needs by a hash of
their ids; only the last few sequences of each are not full.

Edge cases: a null or empty text is its end id alone; repeated rows each get their pieces; an empty
table gives no rows; ties in the dot product go to the larger class; a text of any length is
cut into as many pieces as it takes; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .runtime import Scratch, ship

END_ID = 2
#: Distinct parts of words whose ids a worker keeps; with more it starts anew.
MOST_WORDS = 300_000
#: Rests in one bin of work.
WORK = 20_000


class Tokens:
    """Ids of texts, each distinct part of a word encoded once and kept.

    White space separates words for this vocabulary. Words of ASCII without an apostrophe are cut further where the
    vocabulary's own rule cuts them: between letters, single digits and runs of other characters. Case doesn't matter to it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.encode_special_tokens = True
        self.forget()

    def forget(self) -> None:
        self.flat, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.keys, self.rank = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _learn(self, keys: np.ndarray, parts: list[str]) -> None:
        # Of a plain part only its bytes are to be shown and merged.
        merge = self.encoder.model.tokenize
        ids = [[t.id for t in merge(x if x.isascii() else x.encode().decode("latin-1").translate(_SHOWN))] if _PLAIN.fullmatch(x) else None for x in parts]
        others = [i for i, x in enumerate(ids) if x is None]
        for i, e in zip(others, self.encoder.encode_batch([parts[i] for i in others], add_special_tokens=False), strict=True):
            ids[i] = e.ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        base = len(self.bounds) - 1
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, sizes.sum())])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        to = np.searchsorted(self.keys, keys)
        self.keys, self.rank = np.insert(self.keys, to, keys), np.insert(self.rank, to, base + np.arange(len(parts)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a block in a row, their bounds), each text with its end id."""
        if len(self.keys) > MOST_WORDS:
            self.forget()
        low = tx.LOWER[data]
        start, end, per_text = parts_of(low, offsets)
        h = tx.SpanHash(tx.byte_values(low))(start, end)
        distinct, first, of = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            new = self.keys[at] != distinct
        else:
            new = np.ones(len(distinct), bool)
        if new.any():
            raw = low.tobytes()
            self._learn(distinct[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
        n = len(offsets) - 1
        rank = self.rank[np.searchsorted(self.keys, distinct)][of] if len(h) else np.zeros(0, np.int64)
        size = self.bounds[rank + 1] - self.bounds[rank] if len(h) else np.zeros(0, np.int64)
        total = np.zeros(len(h) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        # One place more for the end id of each text.
        text = np.repeat(np.arange(n), per_text)
        flat = np.full(total[-1] + n, END_ID, np.uint32)
        if len(h):
            step = np.arange(total[-1]) - np.repeat(total[:-1], size)
            flat[np.repeat(total[:-1] + text, size) + step] = self.flat[np.repeat(self.bounds[rank], size) + step]
        return flat, np.concatenate([[0], total[np.cumsum(per_text)] + np.arange(1, n + 1)])


def parts_of(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of the parts of words of case-folded texts, and the number of parts of each text."""
    words = tx.Words(low, offsets)
    kind = _KIND[low]
    # Small Latin letters with marks, two bytes each, are letters to the rule as well.
    lead = np.flatnonzero(low[:-1] == 0xC3)
    lead = lead[(low[lead + 1] >= 0x9F) & (low[lead + 1] != 0xB7)]
    kind[lead], kind[lead + 1] = 1, 1
    # Words with anything beyond plain ASCII are left whole.
    odd = np.zeros(len(low) + 1, np.int32)
    np.cumsum(kind == 4, out=odd[1:])
    plain = odd[words.end] == odd[words.start]
    cut = np.zeros(len(low) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    inner = np.zeros(len(low) + 1, np.int32)
    inner[words.start[plain] + 1] += 1
    inner[words.end[plain]] -= 1
    middle = np.flatnonzero((np.cumsum(inner) > 0) & cut)
    start = np.sort(np.concatenate([words.start, middle]))
    end = np.sort(np.concatenate([words.end, middle]))
    return start, end, np.diff(np.searchsorted(start, offsets))


#: Parts of one kind of characters, as the normaliser and the splitter leave them.
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
#: The byte level: a printable byte shows as itself, the others in turn from U+0100 on. Here as a Latin-1 table.
_SHOWN = [c if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174 else None for c in range(256)]
_LATER = iter(range(256, 512))
_SHOWN = [next(_LATER) if c is None else c for c in _SHOWN]
#: 1 letter, 2 digit, 3 other ASCII, 4 what the rule may join or cut in its own way.
_KIND = np.array([4 if c >= 128 or c == 39 else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.int8)


def coder_of(path: str) -> Tokens:
    """One for each vocabulary and worker, so its words last over tasks of this kind."""
    kept = tx.KEPT.setdefault(__name__, {})
    if path not in kept:
        kept[path] = Tokens(path)
    return kept[path]


PIECE = "doc_id bigint, part bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, loss bigint"


def pieces(docs: DataFrame, tokenizer: str, tokens: int) -> DataFrame:
    """Each document's ids in pieces of at most `tokens`; `loss` counts the ids that bear loss: all but the first of a document."""
    ship(docs.sparkSession)

    def run(batches):
        coder = coder_of(tokenizer)
        for batch in batches:
            for lo, data, offsets in tx.blocks(batch.column(1)):
                flat, bounds = coder.encode(data, offsets)
                size = np.diff(bounds)
                count = -(-size // tokens)
                doc = np.repeat(np.arange(len(size)), count)
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = k * tokens
                length = np.minimum(tokens, size[doc] - start)
                raw = flat.astype("<u4", copy=False)
                crc = [zlib.crc32(raw[a : a + m]) for a, m in zip(bounds[doc] + start, length, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(lo + doc)), pa.array(k), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(size[doc]), pa.array(length - (k == 0))
                ], ["doc_id", "part", "start", "length", "ids_crc32", "doc_tokens", "loss"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tx.lean(run, __name__), PIECE)


def pack(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset of the first dimension in it) of each size vector, by the dot-product heuristic.

    A vector over the limits gets a bin of its own.
    """
    classes, of, counts = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    of = of.reshape(-1)
    members = np.split(np.argsort(of, kind="stable"), np.cumsum(counts)[:-1])
    left = counts.copy()
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    weight = classes / limits  # each dimension as a share of its limit
    alive, n = np.arange(len(classes)), -1
    while len(alive):
        n += 1
        room, at = limits.astype(np.int64).copy(), 0
        while True:
            fits = alive[(classes[alive] <= room).all(axis=1)]
            if not len(fits):
                if at:
                    break
                fits = alive
            dot = weight[fits] @ (room / limits)
            best = fits[len(fits) - 1 - int(np.argmax(dot[::-1]))]
            left[best] -= 1
            item = members[best][left[best]]
            bins[item], offsets[item] = n, at
            at += int(classes[best][0])
            room -= classes[best]
            if not left[best]:
                alive = alive[alive != best]
            if not len(alive) or room[0] <= 0:
                break
    return bins, offsets


def pack_pieces(cut: DataFrame, tokens: int, segments: int, loss: int, work: int = WORK) -> DataFrame:
    """cut with sequence_id and offset; cut must be a written table, as it is counted first."""
    many = max(1, -(-cut.where(F.col("length") < tokens).count() // work))
    limits = np.array([tokens, segments, loss])

    def run(batches):
        # One bin of work after another; each has about `work` rows, numbers only.
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches).sort_by([(c, "ascending") for c in ("bin", "doc_id", "part", "ids_crc32")]).combine_chunks()
        bins = rows.column("bin").to_numpy()
        cuts = [0, *(np.flatnonzero(bins[1:] != bins[:-1]) + 1).tolist(), len(bins)]
        for lo, hi in itertools.pairwise(cuts):
            g = rows.slice(lo, hi - lo).drop_columns("bin")
            sizes = np.stack([g.column("length").to_numpy(), np.ones(hi - lo, np.int64), g.column("loss").to_numpy()], axis=1)
            seq, offset = pack(sizes, limits)
            yield from g.append_column("sequence_id", pa.array((np.int64(bins[lo]) << 32) + seq)).append_column("offset", pa.array(offset)).to_batches()

    rests = cut.where(F.col("length") < tokens).withColumn("bin", F.pmod(F.xxhash64("doc_id", "part", "ids_crc32"), F.lit(many)))
    rests = rests.repartition(many, "bin").mapInArrow(tx.lean(run), PIECE + ", sequence_id bigint, offset bigint")
    full = cut.where(F.col("length") >= tokens).withColumns({"sequence_id": F.monotonically_increasing_id() - F.lit(1 << 62), "offset": F.lit(0).cast("long")})
    return rests.unionByName(full)


def pack_documents(docs: DataFrame, scratch: Scratch, tokenizer: str, tokens: int = 4096, segments: int = 1024, loss: int | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = scratch.table(pieces(docs, tokenizer, tokens), "pieces")
    return pack_pieces(cut, tokens, segments, loss or tokens).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
