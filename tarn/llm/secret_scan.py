"""Secret scans over a block-wise trigram inverted index.

Every rule's regular expression is turned into a Boolean query over the trigrams that each match
must contain. A block of texts is indexed once, for those trigrams only: trigram -> the texts that
hold it. Postings are intersected and united as the query says, and only the texts that remain are
verified with the expression itself. A rule without mandatory trigrams scans each text.

The index folds ASCII case, so it may let too much through but never too little.

Edge cases: a null or empty text has no spans; repeated rows each get their row; other columns are
ignored; matches of one rule never overlap, those of different rules may; an empty table gives no rows; a
text of any length is scanned whole; ties (spans from one place) are ordered by kind.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textops as tx
from .runtime import ship

ALL = ("all",)
#: Strings kept apart while an expression is analysed; beyond it they become a query.
MOST_STRINGS, MOST_CLASS = 24, 8


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    least: int = 0  # least length of `group`
    group: int = 0
    query: tuple = field(default=ALL, compare=False)

    def spans(self, expression: re.Pattern, text: str) -> list[tuple[int, int]]:
        g = self.group
        return [m.span() for m in expression.finditer(text) if m.end(g) - m.start(g) >= self.least]


# The three base rules of the contract, in its order, then widely published key formats.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, 18),
    Rule("hex", r"[0-9a-f]+", re.ASCII, 16),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
)


def conjunction(parts: list[tuple]) -> tuple:
    parts = list(dict.fromkeys(p for p in parts if p != ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def disjunction(parts: list[tuple]) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def of_string(s: str) -> tuple:
    raw = s.lower().encode()
    return conjunction([("tri", raw[i : i + 3]) for i in range(len(raw) - 2)])


def of_strings(strings: set[str]) -> tuple:
    return disjunction([of_string(s) for s in sorted(strings)])


def analyse(nodes) -> tuple[set[str] | None, tuple]:
    """(all strings that the nodes can match, or None if they are many; a query that each match meets)."""
    queries: list[tuple] = []
    run: set[str] = {""}  # what the nodes since the last break can match
    broken = False

    def close() -> None:
        nonlocal run, broken
        queries.append(of_strings(run))
        run, broken = {""}, True

    for op, arg in nodes:
        strings: set[str] | None = None
        query = ALL
        if op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN and not any(k is sre.NEGATE for k, _ in arg):
            chars = {chr(c).lower() for k, a in arg for c in ([a] if k is sre.LITERAL else range(a[0], a[1] + 1) if k is sre.RANGE and a[1] - a[0] < 64 else range(64))}
            strings = chars if len(chars) <= MOST_CLASS and all(k in (sre.LITERAL, sre.RANGE) for k, _ in arg) else None
            if len(chars) > 1 and strings and len(run) * len(strings) > MOST_STRINGS:
                strings = None
        elif op is sre.SUBPATTERN:
            strings, query = analyse(arg[-1])
        elif op is sre.BRANCH:
            parts = [analyse(b) for b in arg[1]]
            strings = None if any(s is None for s, _ in parts) else set().union(*(s for s, _ in parts))
            query = disjunction([of_strings(s) if s is not None else q for s, q in parts])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, body = arg
            s, q = analyse(body)
            if (least, most) == (0, 1) and s is not None:
                strings = s | {""}
            elif least >= 1:
                query = of_strings(s) if s is not None else q
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            continue
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS and all(len(a) < 32 for a in run):
            run = {a + b for a in run for b in strings}
        else:
            close()
            if strings is not None:
                run = strings
            else:
                queries.append(query)
    if broken:
        close()
        return None, conjunction(queries)
    return run, of_strings(run)


def trigram_query(pattern: str, flags: int = 0) -> tuple:
    """The Boolean trigram query of an expression."""
    strings, query = analyse(_parser.parse(pattern, flags))
    return of_strings(strings) if strings is not None else query


def trigrams_of(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "tri" else set().union(set(), *(trigrams_of(q) for q in query[1:] if isinstance(q, tuple)))


class Scanner:
    """Rules with their queries, compiled for one worker."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        self.expressions = [re.compile(r.pattern, r.flags) for r in rules]
        grams = sorted(set().union(set(), *(trigrams_of(q) for q in self.queries)))
        self.number = {g: i for i, g in enumerate(grams)}
        self.table = np.zeros(1 << 24, np.uint16)
        for g, i in self.number.items():
            self.table[g[0] << 16 | g[1] << 8 | g[2]] = i + 1

    def index(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Postings of a block: row per trigram, column per text."""
        n = len(offsets) - 1
        postings = np.zeros((len(self.number) + 1, n), bool)
        if len(data) > 2 and self.number:
            low = tx.LOWER[data].astype(np.int32)
            found = self.table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
            at = np.flatnonzero(found)
            text = np.searchsorted(offsets, at, "right") - 1
            inside = at + 2 < offsets[text + 1]
            postings[found[at[inside]] - 1, text[inside]] = True
        return postings

    def candidates(self, query: tuple, postings: np.ndarray) -> np.ndarray:
        if query == ALL:
            return np.ones(postings.shape[1], bool)
        if query[0] == "tri":
            return postings[self.number[query[1]]]
        parts = [self.candidates(q, postings) for q in query[1:]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each text, (start, rule number, end) in code points, by start and rule."""
        n = len(offsets) - 1
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        postings = self.index(data, offsets)
        texts: dict[int, str] = {}
        for k, (rule, query, expression) in enumerate(zip(self.rules, self.queries, self.expressions, strict=True)):
            for i in np.flatnonzero(self.candidates(query, postings)):
                text = texts.get(i)
                if text is None:
                    text = texts[i] = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                found[i] += [(s, k, e) for s, e in rule.spans(expression, text)]
        for x in found:
            x.sort()
        return found


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: key, secrets array<struct<kind, start, end>> in code points, end exclusive."""
    ship(docs.sparkSession)
    kinds = [r.kind for r in rules]

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            rows = []
            for _, data, offsets in tx.blocks(batch.column(1)):
                rows += [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in x] for x in scanner.scan(data, offsets)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["key", "secrets"])

    key_type = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("key"), docs[text].cast("string").alias("text")).mapInArrow(tx.lean(run), f"key {key_type}, secrets array<struct<kind string, start bigint, end bigint>>")
    return out.withColumnRenamed("key", key)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the scan contract."""
    from pyspark.sql import functions as F

    base = [r.kind for r in BASE]
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda a: F.array_join(F.transform(a, line), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    return scan_secrets(docs).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(joined(F.filter("secrets", lambda x: x["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )

