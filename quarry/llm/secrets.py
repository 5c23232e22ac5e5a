"""Secrets in texts: fixed base patterns, and formats learned by grammar inference.

For every labelled credential format, and for all of them together, a probabilistic prefix tree is built from the strings
as they are, character by character, and statistically compatible states are merged (Hoeffding bounds on the frequencies of
leaving a state by each symbol and of ending in it). The automata so learn the order of a format: what its head and its
marks are stays a chain of states, what is random becomes a loop, whose probability of ending tells lengths, without any
table of them. A character that a state has not seen has the state's share of unseen ones; reading goes on in the most usual
next state, so a head that is a little off costs some bits and no more. Together the formats tell what credentials have in
common; they find formats of the same grammar that nobody listed.

A candidate starts with a run of credential characters or behind a mark (= / . + - _) in it, and ends with the run or
before a mark. Its score under an automaton is the log-likelihood ratio of its characters against ordinary strings (a chain
over kinds of characters, each with its own frequencies). Every candidate of a run is scored under every automaton at once
by dynamic programming over its characters: of all ways into one state the best is kept, and the spans are those that
do not overlap and together lie highest above the cut between labelled credentials and labelled ordinary strings. A run in
which no letter meets a digit and no capital follows a small letter holds no candidate above the cut. Spans of kind
``format`` within a base span add nothing; base spans always stay.

Nulls and odd cases: a null or empty text has no spans, counts 0 and the hash of the empty string; ids may be null or
repeat; extra columns are ignored; an empty table gives an empty result. Offsets are code points, the end exclusive. The
work grows in proportion to a text's length, however long its runs.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import blocks, small_batches

#: The base patterns (fixed values); kinds in the order in which ties are listed.
BASE = {
    "assign": re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
}
KINDS = ("assign", "access", "hex", "format")
#: Each match of the assign pattern holds one of these, in some case.
HINTS = ("passw", "secret", "token", "api")
RUN = "A-Za-z0-9+/_.=-"
MARK = re.compile("[=/.+_-]")
UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALNUM = UPPER + LOWER + DIGIT
#: Public credential formats: fixed text, or (alphabet, least length, greatest length).
FORMATS: dict[str, list[str | tuple[str, int, int]]] = {
    "cloud access key": ["AKIA", (UPPER + "234567", 16, 16)],
    "code host token": ["ghp_", (ALNUM, 36, 36)],
    "code host server token": ["ghs_", (ALNUM, 36, 36)],
    "chat bot token": ["xoxb-", (DIGIT, 10, 13), "-", (DIGIT, 10, 13), "-", (ALNUM, 24, 24)],
    "map service key": ["AIza", (ALNUM + "_-", 35, 35)],
    "payment key": ["sk_live_", (ALNUM, 24, 34)],
    "model service key": ["sk-", (ALNUM, 20, 64)],
    "package index token": ["npm_", (ALNUM, 36, 36)],
    "web token": ["eyJ", (ALNUM, 17, 60), ".eyJ", (ALNUM, 30, 500), ".", (ALNUM + "_-", 43, 342)],
    "mail service key": ["SG.", (ALNUM + "_-", 22, 22), ".", (ALNUM + "_-", 43, 43)],
}
EACH = 40


def labelled(seed: int = 10) -> list[tuple[str, str | None]]:
    """(string, its format, or None for an ordinary one): EACH of every format and as many ordinary strings."""
    rng = Random(seed)
    piece = lambda p: p if isinstance(p, str) else "".join(rng.choices(p[0], k=rng.randint(p[1], p[2])))
    out: list[tuple[str, str | None]] = [("".join(map(piece, parts)), name) for name, parts in FORMATS.items() for _ in range(EACH)]
    word = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 5)))
    number = lambda: str(rng.randint(0, 10 ** rng.randint(1, 12)))
    heads = [p[0].rstrip("_.-") for p in FORMATS.values() if isinstance(p[0], str)]
    for _ in range(EACH * len(FORMATS) // 4):
        out += [(sep.join(word() for _ in range(rng.randint(3, 7))), None) for sep in ("", "-", "_", "/")]
        out += [(sep.join(number() for _ in range(rng.randint(1, 4))), None) for sep in (".", "-", "/")]
        out.append((".".join(word().capitalize() for _ in range(4)) + str(rng.randint(1, 2030)), None))
        out.append(("".join(word().capitalize() for _ in range(rng.randint(2, 4))), None))
        out.append((rng.choice("_-").join([word().upper(), *(word().upper() for _ in range(rng.randint(0, 3)))]), None))
        out.append((word() + rng.choice("_-") + number() + rng.choice(["", word()]), None))
        out.append((rng.choice(heads) + rng.choice("-_.") + rng.choice("-_").join(word() for _ in range(rng.randint(1, 8))), None))
    return out


class Automaton:
    """A probabilistic automaton by merging compatible states of a prefix tree.

    ``alpha`` is the confidence parameter of the Hoeffding test that two states leave and end alike."""

    def __init__(self, strings: list[str], alpha: float = 0.05) -> None:
        self.go: list[dict[str, int]] = [{}]
        self.n: list[dict[str, int]] = [{}]
        self.end: list[int] = [0]
        for s in strings:
            at = 0
            for c in s:
                if c not in self.go[at]:
                    self.go[at][c] = len(self.go)
                    self.go.append({})
                    self.n.append({})
                    self.end.append(0)
                self.n[at][c] = self.n[at].get(c, 0) + 1
                at = self.go[at][c]
            self.end[at] += 1
        self.root = math.sqrt(0.5 * math.log(2 / alpha))
        red, blue = [0], [(0, c) for c in sorted(self.go[0])]
        while blue:
            parent, c = blue.pop(0)
            q = self.go[parent][c]
            if q in red:
                continue
            for r in red:
                if self.alike(r, q):
                    self.go[parent][c] = r
                    self.fold(r, q)
                    break
            else:
                red.append(q)
            blue = [(r, c) for r in red for c in sorted(self.go[r]) if self.go[r][c] not in red]
        self.red = red

    def total(self, q: int) -> int:
        return self.end[q] + sum(self.n[q].values())

    def alike(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            x, y = self.total(a), self.total(b)
            if not x or not y:
                continue
            bound = self.root * (1 / math.sqrt(x) + 1 / math.sqrt(y))
            if abs(self.end[a] / x - self.end[b] / y) > bound:
                return False
            for c in self.go[a].keys() | self.go[b].keys():
                if abs(self.n[a].get(c, 0) / x - self.n[b].get(c, 0) / y) > bound:
                    return False
                if c in self.go[a] and c in self.go[b]:
                    todo.append((self.go[a][c], self.go[b][c]))
        return True

    def fold(self, into: int, q: int) -> None:
        """Add the tree below q to the automaton at into."""
        todo = [(into, q)]
        while todo:
            r, q = todo.pop()
            self.end[r] += self.end[q]
            for c, n in self.n[q].items():
                self.n[r][c] = self.n[r].get(c, 0) + n
                if c in self.go[r]:
                    todo.append((self.go[r][c], self.go[q][c]))
                else:
                    self.go[r][c] = self.go[q][c]


def kind(c: str) -> str:
    """Kind of a character: a digit, capital or small letter; marks are kinds of their own."""
    return "0" if "0" <= c <= "9" else "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else c


SIZE = {"A": 26, "a": 26, "0": 10}


class Ordinary:
    """Ordinary strings: a chain over kinds, and the frequencies of characters of a kind."""

    def __init__(self, strings: list[str]) -> None:
        pairs = Counter(p for s in strings for p in zip([""] + [kind(c) for c in s], [kind(c) for c in s], strict=False))
        before = Counter(a for s in strings for a in ["", *map(kind, s[:-1])])
        chars = Counter("".join(strings))
        kinds = Counter(map(kind, "".join(strings)))
        alphabet = ["A", "a", "0", *"+/_.=-"]
        self.bits = {(a, c): math.log2((pairs[a, kind(c)] + 0.5) / (before[a] + 0.5 * len(alphabet))) + math.log2((chars[c] + 1) / (kinds[kind(c)] + SIZE.get(kind(c), 1))) for a in ["", *alphabet] for c in ALNUM + "+/_.=-"}


class Format:
    """An automaton with, for each state: character -> (next state, bits), what any other costs and leads to, and bits of ending."""

    def __init__(self, strings: list[str]) -> None:
        auto = Automaton(strings)
        place = {q: i for i, q in enumerate(auto.red)}
        self.step: list[dict[str, tuple[int, float]]] = []
        self.other: list[tuple[int, float]] = []
        self.end: list[float] = []
        for q in auto.red:
            total, types = auto.total(q), len(auto.n[q]) + (auto.end[q] > 0)
            known = {c: (place[auto.go[q][c]], math.log2(n / (total + types))) for c, n in auto.n[q].items()}
            self.step.append(known)
            usual = max(auto.n[q], key=lambda c: (auto.n[q][c], c), default=None)
            self.other.append((place[q] if usual is None else place[auto.go[q][usual]], math.log2(types / (total + types) / 64)))
            self.end.append(math.log2((auto.end[q] + 0.1) / (total + types)))


class Formats:
    """The learned automata, the ordinary strings, and the cut between both."""

    def __init__(self, table: list[tuple[str, str | None]]) -> None:
        self.ordinary = Ordinary([s for s, y in table if y is None])
        names = list(dict.fromkeys(y for _, y in table if y))
        each = [[s for s, y in table if y == name] for name in names]
        parts = [*each, [s for some in each for s in some]]
        # all states of all automata in one row
        self.step: list[dict[str, tuple[int, float]]] = []
        self.other: list[tuple[int, float]] = []
        self.end: list[float] = []
        self.start: list[int] = []
        for f in map(Format, parts):
            at = len(self.step)
            self.start.append(at)
            self.step += [{c: (at + q, b) for c, (q, b) in x.items()} for x in f.step]
            self.other += [(at + q, b) for q, b in f.other]
            self.end += f.end
        # between the ordinary string that looks most like one and the credentials, but for a hundredth of them
        known = sorted(self.ratio(s) for s, y in table if y)
        self.cut = (known[len(known) // 100] + max(0.0, max(self.ratio(s) for s, y in table if y is None))) / 2

    def ratio(self, s: str) -> float:
        """The best log-likelihood ratio of a whole string."""
        best = -math.inf
        for q in self.start:
            score, before = 0.0, ""
            for c in s:
                q, bits = self.step[q].get(c) or self.other[q]
                score += bits - self.ordinary.bits[before, c]
                before = kind(c)
            best = max(best, score + self.end[q])
        return best

    def is_secret(self, candidate: str) -> bool:
        return self.ratio(candidate) >= self.cut

    def chosen(self, text: str, a: int, b: int) -> tuple[list[tuple[int, int]], float]:
        """The candidates in the run text[a:b] that don't overlap and together lie highest above the cut, and by how much.

        value[i]: the best sum for what ends at or before i; active: of each state the best way into it, as (value before its
        start plus its score, start, score)."""
        while b > a and text[b - 1] in ".=-":
            b -= 1
        value, begun = [0.0] * (b - a + 1), [-1] * (b - a + 1)
        active: dict[int, tuple[float, int, float]] = {}
        begins, before = True, ""
        for i in range(b - a):
            c = text[a + i]
            if begins:
                for q in self.start:
                    if q not in active or active[q][0] < value[i]:
                        active[q] = (value[i], i, 0.0)
            now: dict[int, tuple[float, int, float]] = {}
            usual, first = self.ordinary.bits[before, c], self.ordinary.bits["", c]
            for q, (whole, at, score) in active.items():
                to, bits = self.step[q].get(c) or self.other[q]
                gain = bits - (first if at == i else usual)
                if to not in now or now[to][0] < whole + gain:
                    now[to] = (whole + gain, at, score + gain)
            active = now
            before = kind(c)
            begins = before == c and c not in "0Aa"
            value[i + 1] = value[i]
            if i + 1 == b - a or (MARK.match(text, a + i + 1) and c not in ".=-"):
                for q, (whole, at, score) in active.items():
                    more = whole + self.end[q] - self.cut
                    if score + self.end[q] >= self.cut and more > value[i + 1]:
                        value[i + 1], begun[i + 1] = more, at
        out, i = [], b - a
        while i > 0:
            if begun[i] >= 0:
                out.append((a + begun[i], a + i))
                i = begun[i]
            else:
                i -= 1
        return out[::-1], value[-1]

    def in_run(self, text: str, a: int, b: int) -> list[tuple[int, int]]:
        """The spans in the run text[a:b]."""
        # parts of one credential that touch, or have one of its inner marks between them, are one span
        joined: list[tuple[int, int]] = []
        for x, y in self.chosen(text, a, b)[0]:
            if joined and text[joined[-1][1] : x] in ("", ".", "-", "_"):
                joined[-1] = (joined[-1][0], y)
            else:
                joined.append((x, y))
        return joined

    def secrets(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the credentials in a text, in order."""
        out: list[tuple[int, int]] = []
        done = 0
        while m := SWITCH.search(text, done):
            a, b = m.start(), TAIL.match(text, m.end()).end()
            while a > done and RUN_CHAR.match(text, a - 1):
                a -= 1
            if b - a >= LEAST:
                out += self.in_run(text, a, b)
            done = b
        return out


#: A letter beside a digit, or a capital behind a small letter.
SWITCH = re.compile(r"[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]")
RUN_CHAR, TAIL = re.compile(f"[{RUN}]"), re.compile(f"[{RUN}]*")
#: Fewer characters can't reach the cut.
LEAST = 4


@functools.lru_cache(maxsize=1)
def learned() -> Formats:
    return Formats(labelled())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base patterns."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in BASE["assign"].finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in BASE["access"].finditer(text) if m.end() - m.start() >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in BASE["hex"].finditer(text)])


def all_spans(text: str, formats: Formats) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) in order of start, then kind."""
    base = base_spans(text)
    begins, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    more = []
    for a, b in formats.secrets(text):
        i = bisect_right(begins, a)
        if not i or reach[i - 1] < b:
            more.append((a, 3, b))
    return base, sorted(base + more)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked_text(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with every span, or chain of overlapping spans, replaced by the mask."""
    pieces, at, covered = [], 0, 0
    for a, _, b in spans:
        if a >= covered:
            pieces += [text[at:a], mask]
        covered = max(covered, b)
        at = covered
    return "".join([*pieces, text[at:]])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, mask: str | None = None) -> DataFrame:
    """For every row of docs: id_col, n_assign, n_access, n_hex, base (spans), spans; keep: columns to carry along.

    mask: also return the text with every span replaced by it, as ``masked``."""
    small_batches(docs.sparkSession)
    formats = docs.sparkSession.sparkContext.broadcast(learned())  # automata of a few states
    carried = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep or [])]
    rows = docs.select(F.col(id_col).alias("id"), *carried, F.col(text_col).cast("string").alias("__text"))
    fields = [f for f in rows.schema.fields if f.name != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _ in blocks(batches, "__text"):
            texts = part.column("__text")
            counts, base_col, span_col, masked = [], [], [], []
            for i in range(len(texts)):
                text = texts[i].as_py()
                base, spans = all_spans(text, formats.value) if text else ([], [])
                counts.append([sum(k == j for _, k, _ in base) for j in range(3)])
                base_col.append(written(base))
                span_col.append(written(spans))
                if mask is not None:
                    masked.append(masked_text(text, spans, mask) if spans else text)
            c = np.array(counts, np.int64).reshape(-1, 3)
            extra = [pa.array(masked, pa.string())] if mask is not None else []
            yield pa.RecordBatch.from_arrays(
                [*(part.column(f.name) for f in fields), *(pa.array(c[:, j]) for j in range(3)), pa.array(base_col, pa.string()), pa.array(span_col, pa.string()), *extra],
                names=[*(f.name for f in fields), "n_assign", "n_access", "n_hex", "base", "spans", *(["masked"] if extra else [])],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_assign long, n_access long, n_hex long, base string, spans string" + (", masked string" if mask is not None else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col) if not keep else rows.mapInArrow(run, schema)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base_sha256, spans for every row of docs."""
    return secret_spans(docs, id_col, text_col).select(id_col, "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", mask: str = "[secret]") -> DataFrame:
    """docs with every span in the text replaced by mask and the length column, if there is one, brought up to date.

    All rows and columns stay, in any order, also rows that repeat; null and empty texts stay as they are; an empty table
    gives an empty one."""
    out = secret_spans(docs, id_col, text_col, keep=docs.columns, mask=mask)
    new = []
    for i, c in enumerate(docs.columns):
        kind = docs.schema[c].dataType
        value = F.col("masked") if c == text_col else F.when(F.col("spans") != "", F.length("masked").cast(kind)).otherwise(F.col(f"k{i}")) if c == length_col else F.col(f"k{i}")
        new.append(value.alias(c))
    return out.select(*new)


__all__ = ["Automaton", "Format", "Formats", "labelled", "learned", "mask_secrets", "secret_scan", "secret_spans"]
