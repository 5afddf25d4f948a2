"""Secret scans by a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: every match must contain those trigrams.
Each run of texts gets an index from the trigrams that any query names to the texts that hold them; a query is answered by
intersecting and joining postings, and only the candidates are searched with the rule itself. A rule whose matches need
not contain any trigram (a run of hexadecimal digits) is searched for in every text.

A null text counts as empty and gives no spans. Offsets are code points, the end exclusive. Repeated rows give repeated
results. Matches of one rule are leftmost and don't overlap; those of different rules may.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import partial, reduce
from re import _constants as kinds
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, slices, strings


@dataclass(frozen=True)
class Rule:
    """A match counts if its group (0: all of it) has at least that many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False
    #: A pattern for the search in time linear in the text: its matches are the rule's, and others in which its group `all` has no part.
    linear: str = ""

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: The first three kinds and their patterns are given.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Public shapes of other credentials.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    # a run that leads to no match is passed over at once
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 36, False, r"eyJ(?:[A-Za-z0-9_-]++(?P<all>\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)?)?"),
    Rule("bearer", r"bearer\x20+([A-Za-z0-9._~+/-]+)", 1, 20, True),
    # only where a run of letters starts
    Rule("url", r"[a-z]+://[^\x20\x09-\x0D/:@]+:([^\x20\x09-\x0D/:@]+)@", 1, 6, False, r"(?<![a-z])[a-z]++://[^\x20\x09-\x0D/:@]++:([^\x20\x09-\x0D/:@]++)@"),
)
RULES = BASE + MORE

# A query is None (any text), a trigram, or ("and" | "or", parts).
Query = None | str | tuple


def both(*parts: Query) -> Query:
    kept = tuple(dict.fromkeys(p for p in parts if p is not None))
    return kept[0] if len(kept) == 1 else ("and", kept) if kept else None


def either(*parts: Query) -> Query:
    if any(p is None for p in parts) or not parts:
        return None
    kept = tuple(dict.fromkeys(parts))
    return kept[0] if len(kept) == 1 else ("or", kept)


def of_text(text: str) -> Query:
    return both(*(text[i : i + 3] for i in range(len(text) - 2)))


@dataclass
class Known:
    """What is known of an expression's matches: all of them (exact), or how they start and end and a query that holds."""

    exact: frozenset[str] | None = None
    starts: frozenset[str] = frozenset([""])
    ends: frozenset[str] = frozenset([""])
    query: Query = field(default=None)

    def open(self) -> Known:
        if self.exact is None:
            return self
        return Known(None, frozenset(x[:2] for x in self.exact), frozenset(x[-2:] for x in self.exact), either(*map(of_text, self.exact)))


#: Sets of strings that outgrow this count as unknown.
MOST = 64


def then(a: Known, b: Known) -> Known:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        return Known(frozenset(x + y for x in a.exact for y in b.exact))
    heads, tails = a.exact or a.ends, b.exact or b.starts
    middle = either(*(of_text(x[-2:] + y[:2]) for x in heads for y in tails)) if len(heads) * len(tails) <= MOST else None
    grown = a.exact is not None and len(a.exact) * len(b.starts) <= MOST
    starts = frozenset((x + y)[:2] for x in a.exact for y in (b.exact or b.starts)) if grown else a.open().starts
    grown = b.exact is not None and len(a.ends) * len(b.exact) <= MOST
    ends = frozenset((x + y)[-2:] for x in (a.exact or a.ends) for y in b.exact) if grown else b.open().ends
    return Known(None, starts, ends, both(a.open().query, b.open().query, middle))


def one_of(parts: Sequence[Known]) -> Known:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MOST:
        return Known(frozenset().union(*(p.exact for p in parts)))
    opened = [p.open() for p in parts]
    return Known(None, frozenset().union(*(p.starts for p in opened)), frozenset().union(*(p.ends for p in opened)), either(*(p.query for p in opened)))


def low(code: int) -> str:
    """A character as the index has it: bytes as Latin-1, A-Z lower-cased."""
    return chr(code).lower() if 65 <= code <= 90 else chr(code).encode().decode("latin-1")


def analysed(items: Sequence) -> Known:
    """What is known of a parsed expression."""
    out = Known(frozenset([""]))
    for op, arg in items:
        if op is kinds.LITERAL:
            here = Known(frozenset([low(arg)]))
        elif op is kinds.IN and (found := listed(arg)) is not None:
            here = Known(frozenset(found))
        elif op is kinds.SUBPATTERN:
            here = analysed(arg[3])
        elif op is kinds.BRANCH:
            here = one_of([analysed(x) for x in arg[1]])
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT):
            least, most, inner = arg
            each = analysed(inner)
            here = reduce(then, [each] * min(least, 40), Known(frozenset([""])))
            if most == least + 1 and not least:
                here = one_of([here, each])
            elif most != least:
                here = then(here, Known()) if not least else Known(None, here.open().starts, each.open().ends, here.open().query)
        elif op in (kinds.AT, kinds.ASSERT, kinds.ASSERT_NOT):
            continue
        else:
            here = Known()
        out = then(out, here)
    return out


def listed(arg: Sequence) -> list[str] | None:
    """The characters of a class, if they are few."""
    out: list[str] = []
    for op, x in arg:
        if op is kinds.LITERAL:
            out.append(low(x))
        elif op is kinds.RANGE and x[1] - x[0] < 10:
            out += map(low, range(x[0], x[1] + 1))
        else:
            return None
    return out if len(out) <= 10 else None


def trigram_query(pattern: str) -> Query:
    """A query over lower-cased trigrams that every text with a match fulfils; None if nothing is sure."""
    return analysed(parser.parse(pattern)).open().query


def named(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(named, query[1]))


class Scanner:
    """Rules with their queries, for run after run of texts."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.rules = [(k, r, replace(r, pattern=r.linear or r.pattern).compiled(), trigram_query(r.pattern)) for k, r in enumerate(rules)]
        grams = sorted(set().union(set(), *(named(q) for *_, q in self.rules)))
        self.grams = {g: i for i, g in enumerate(grams)}
        self.code = np.zeros(1 << 24, np.uint16)
        for g, i in self.grams.items():
            a, b, c = g.encode("latin-1")
            self.code[a << 16 | b << 8 | c] = i + 1

    def postings(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """For each trigram that a query names, the texts that hold it."""
        small = LOWER[data].astype(np.int32)
        gram = self.code[small[:-2] << 16 | small[1:-1] << 8 | small[2:]] if len(small) > 2 else np.zeros(0, np.uint16)
        where = np.flatnonzero(gram)
        text = np.searchsorted(at, where, "right") - 1
        inside = where + 2 < at[text + 1]
        found = np.unique(gram[where[inside]].astype(np.int64) << 32 | text[inside])
        cut = np.searchsorted(found >> 32, np.arange(1, len(self.grams) + 2))
        return [found[cut[i] : cut[i + 1]] & 0xFFFFFFFF for i in range(len(self.grams))]

    def answer(self, query: Query, postings: list[np.ndarray]) -> np.ndarray:
        if isinstance(query, str):
            return postings[self.grams[query]]
        kind, parts = query
        found = [self.answer(p, postings) for p in parts]
        return reduce(np.intersect1d if kind == "and" else np.union1d, sorted(found, key=len))

    def spans(self, data: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule, end), in that order."""
        postings, texts = self.postings(data, at), {}
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(at) - 1)]
        for k, rule, pattern, query in self.rules:
            for i in range(len(out)) if query is None else self.answer(query, postings).tolist():
                if i not in texts:
                    texts[i] = data[at[i] : at[i + 1]].tobytes().decode()
                out[i] += [(m.start(), k, m.end()) for m in self.search(rule, pattern, texts[i])]
        return [sorted(x) for x in out]

    @staticmethod
    def search(rule: Rule, pattern: re.Pattern, text: str) -> Iterator[re.Match]:
        whole = pattern.groupindex.get("all", 0)
        return (m for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least and m.end(whole) >= 0)


def lengthened(rule: Rule) -> Rule:
    """A lone run of one class is searched for at its least length at once: the same maximal runs, without the short ones."""
    if not rule.group and rule.least and (m := re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)):
        return Rule(rule.kind, f"{m[1]}{{{rule.least},}}", 0, rule.least, rule.any_case)
    return rule


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _scan(batches: Iterator[pa.RecordBatch], rules: Sequence[Rule], masked: str | None) -> Iterator[pa.RecordBatch]:
    scanner = Scanner([lengthened(r) for r in rules])
    kind_names = [r.kind for r in rules]
    for batch in batches:
        data, at = strings(batch.column(batch.num_columns - 1))
        for i, j in slices(at, 1 << 22):
            part = at[i : j + 1]
            found = scanner.spans(data[part[0] : part[-1]], part - part[0])
            flat = [x for y in found for x in y]
            starts = pa.array([x[0] for x in flat], pa.int64()), pa.array([kind_names[x[1]] for x in flat], pa.string()), pa.array([x[2] for x in flat], pa.int64())
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in found]))), pa.int32()), pa.StructArray.from_arrays([starts[1], starts[0], starts[2]], ["kind", "start", "end"]))
            out, names = [*batch.slice(i, j - i).columns, spans], [*batch.schema.names, "spans"]
            if masked is not None:
                out[-2] = pa.array([mask(t, x, masked) for t, x in zip(out[-2].to_pylist(), found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(out, names)


def mask(text: str | None, spans: list[tuple[int, int, int]], by: str) -> str | None:
    """The text with what any span covers replaced, once for each run of overlapping spans."""
    if not spans:
        return text
    out, done = [], 0
    for start, _, end in spans:
        if start >= done:
            out += [text[done:start], by]
        done = max(done, end)
    return "".join(out) + text[done:]


def scan(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", columns: tuple[str, ...] = ("doc_id",), masked: str | None = None) -> DataFrame:
    """The given columns, the text (with secrets replaced by `masked`, if that is given) and spans: kind, start, end by start, then rule."""
    source = df.select(*[F.col(f"`{c}`") for c in columns if c != text], F.col(f"`{text}`"))
    return source.mapInArrow(partial(_scan, rules=tuple(rules), masked=masked), T.StructType([*source.schema.fields, T.StructField("spans", SPANS)]))


def joined(spans: Column, kinds_of: Sequence[str] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    chosen = spans if kinds_of is None else F.filter(spans, lambda s: s["kind"].isin(*kinds_of))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


Scan = Callable[..., DataFrame]
