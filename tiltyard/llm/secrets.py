"""Secret scans: all rules as one minimal automaton, run once over the bytes of every text."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltyard.llm.automaton import Automaton, backwards, parse
from tiltyard.llm.base import as_arrow, map_arrow, small_batches, text_bytes, trim


@dataclass(frozen=True)
class Rule:
    """Leftmost, longest, non-overlapping matches of ``head`` and then ``body``; those whose part after the
    head has fewer than ``least`` characters are dropped, though what they cover stays used up. A match runs on
    over a ``tail`` where one follows."""

    kind: str
    head: str
    body: str
    least: int = 0
    tail: str = ""


_ANY_CASE = {c: f"[{c}{c.upper()}]" for c in "abcdefghijklmnopqrstuvwxyz"}


def any_case(word: str) -> str:
    return "".join(_ANY_CASE.get(c, c) for c in word)


_NAMES = "(" + "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
BASE = (
    Rule("assign", _NAMES + r"""["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", "AKIA", "[A-Z0-9]+", 16),
    Rule("hex", "", "[0-9a-f]{24,}"),  # the same as runs of hexadecimal digits, less those under 24
)
_KEY = r"([A-Z]+\x20)*PRIVATE\x20KEY-----"
_BETWEEN = r"([\x20\t\r\n]|\\[nrt])+"  # line ends may be escaped, or be spaces
# To the END marker; without one over header lines, lines of 16 or more characters, and a shorter last one.
_TO_END = r"([\x20\t\r\nA-Za-z0-9+/=:;,._@\\]|-[\x20\t\r\nA-Za-z0-9+/=:;,._@\\])*-----END\x20" + _KEY
_LINES = rf"({_BETWEEN}[A-Z][A-Za-z-]*:\x20[A-Za-z0-9,-]+)*({_BETWEEN}[A-Za-z0-9+/=]{{16,}})+((\r?\n|(\\r)?\\n|\x20)[A-Za-z0-9+/=]+)?"
MORE = (
    Rule("pem", "", r"-----BEGIN\x20" + _KEY, tail=f"({_TO_END}|{_LINES})"),
    Rule("forge", "gh[opsur]_", "[A-Za-z0-9]+", 36),
    Rule("chat", "xox[abprs]-", "[A-Za-z0-9-]+", 10),
    Rule("cloud", "AIza", "[A-Za-z0-9_-]+", 35),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]+", 8),
    Rule("bearer", any_case("bearer") + r"\x20+", "[A-Za-z0-9._~+/-]+", 20),
)
RULES = BASE + MORE


class Scanner:
    """All rules as two minimal automata: read from right to left, in one pass over the bytes, the first accepts
    wherever a match of any rule begins; read from there, the second accepts where matches, and their heads, end."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        whole = [parse(r.head + r.body) for r in rules]
        headed = [r for r, rule in enumerate(rules) if rule.head and rule.least]
        self.starts = Automaton([backwards(x) for x in whole], anywhere=True)
        to_end = [parse(f"{r.head}{r.body}({r.tail})?") if r.tail else x for r, x in zip(rules, whole)]
        self.ends = Automaton(to_end + [parse(rules[r].head) for r in headed], anywhere=False)
        self.head_bit = {r: 1 << (len(rules) + i) for i, r in enumerate(headed)}

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes of ``data``, by start and then rule: of each rule those that begin at no
        earlier match of it."""
        n, texts = len(data), len(offsets) - 1
        own = np.repeat(np.arange(texts), np.diff(offsets))  # a symbol between texts resets the automaton
        symbols = np.full(n + texts, self.starts.width - 1, np.int32)
        symbols[np.arange(n) + own] = self.starts.klass[data]
        after = self.starts.accepts[self.starts.states_after(symbols)]
        hit = np.flatnonzero(after)
        which = after[hit]
        found = []
        for r, rule in enumerate(self.rules):
            at = hit[(which >> r) & 1 == 1]
            text = np.searchsorted(offsets[1:] + np.arange(1, texts + 1), at, "right")
            at = at - text
            i = 0
            while i < len(at):
                start, limit = int(at[i]), int(offsets[text[i] + 1])
                end, head = self._ends(r, data, start, limit)
                if end - head >= rule.least:
                    found.append((start, end, r))
                i = max(i + 1, int(np.searchsorted(at, end)))
        return sorted(found, key=lambda x: (x[0], x[2]))

    def _ends(self, rule: int, data: np.ndarray, start: int, limit: int) -> tuple[int, int]:
        """Where the longest match of a rule that begins here ends, and where the longest head in it does."""
        state, at, size, end, heads = 0, start, 256, start, [start]
        while at < limit:
            stop = min(limit, at + size)  # most matches are short
            state, ends, marks = self.ends.run(data[at:stop].tobytes(), state, 1 << rule, self.head_bit.get(rule, 0))
            end = at + ends if ends else end
            heads += [at + m for m in marks]
            if state < 0:
                break
            at, size = stop, size * 16
        return end, max(h for h in heads if h <= end)

    def scan(self, column: pa.Array, limit: int = 1 << 20) -> list[list[tuple[str, int, int]]]:
        """The spans of each text in code points."""
        data, off = text_bytes(column)
        out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(off) - 1)]
        lo = 0
        while lo < len(off) - 1:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            part, ends = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            if found := self.spans(part, ends):
                points = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
                text = np.searchsorted(ends, [s for s, _, _ in found], "right") - 1
                for (s, e, r), t in zip(found, text.tolist()):
                    zero = points[ends[t]]
                    out[lo + t].append((self.rules[r].kind, int(points[s] - zero), int(points[e] - zero)))
            lo = hi
        return out


def digest(spans: list[tuple[str, int, int]], kinds: set[str] | None = None) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans if kinds is None or k in kinds)


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_held: dict[tuple, Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """The rules' automata, compiled once a process."""
    if rules not in _held:
        _held[rules] = Scanner(rules)
    return _held[rules]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (doc_id, spans): each document's secrets as (kind, start, end), in code points, end exclusive,
    by start and then in the rules' order.

    One row a row of ``docs``: repeated rows and null ids give their own rows; a null or empty text has no
    spans; no text is cut, whatever its length; other columns are ignored.
    """

    def scan(batch: pa.RecordBatch) -> dict:
        found = scanner(rules).scan(batch.column(1))
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found]
        return {"doc_id": batch.column(0), "spans": spans}

    return map_arrow(docs.select("doc_id", "text"), scan, f"doc_id long, spans {_SPANS}")


def base_digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``scan_secrets`` as counts and digests of the three base kinds, and all spans as one string."""
    base = [r.kind for r in BASE]

    def scan(batch: pa.RecordBatch) -> dict:
        found = scanner(rules).scan(batch.column(1))
        count = {f"n_{k}": [sum(x[0] == k for x in spans) for spans in found] for k in base}
        return count | {
            "doc_id": batch.column(0),
            "base_sha256": [hashlib.sha256(digest(x, {*base}).encode()).hexdigest() for x in found],
            "spans": [digest(x) for x in found],
        }

    return map_arrow(docs.select("doc_id", "text"), scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret's span replaced by ``mark``; overlapping spans are replaced as one.

    All rows and columns stay, whatever they are called; null texts stay null, and ``n_chars``, where there
    is one, follows the new text.
    """
    types = dict(docs.dtypes)
    kinds = docs.schema

    def clean(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = scanner(rules).scan(batch.column(at))
            if any(found):
                texts = batch.column(at).to_pylist()
                for i, spans in enumerate(found):
                    if spans:
                        texts[i] = replaced(texts[i], spans, mark)
                batch = batch.set_column(at, batch.schema.field(at), as_arrow(texts, batch.schema.field(at).type))
            yield batch
            trim()

    out = small_batches(docs).mapInArrow(clean, kinds)
    if types.get("n_chars") in ("bigint", "int"):
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(types["n_chars"]))
    return out


def replaced(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    parts, at = [], 0
    merged: list[list[int]] = []
    for _, s, e in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        parts += [text[at:s], mark]
        at = e
    return "".join([*parts, text[at:]])
