"""Secret scans with one combined deterministic automaton.

Every rule is a small regular expression over bytes. All rules are compiled together: Thompson NFAs,
subset construction over byte classes, minimisation, and transition arrays. One pass over a text's bytes drives
the combined unanchored automaton and keeps the state after every byte. A batch of texts is cut into
chunks that step through the arrays side by side; a chunk whose predecessor turns out to end inside a possible match
is run again from that state. Each state knows which rules accept in it and which rules have an open attempt in it, so the
states hold, for every rule, the runs of bytes with an attempt open, and whether the rule accepted in them: all matches lie in
runs with an accept, which start where an attempt began. Such a run, and nothing else of the text, is cut into spans by the rule's own anchored automaton made in
the same way (leftmost start, longest end, non-overlapping, as the regular expression itself would be
matched). The automata are compiled once on the driver and travel with the tasks (well under 1 MB).

Null texts count as empty and hold nothing. Repeated rows and null or repeated ids give a row each. An empty table
gives an empty table; extra columns are ignored. Texts of any length are scanned whole.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Rule:
    """A kind of secret. expression: literals, [classes], (a|b), ?, *, + and {n} after one atom; matches that are shorter than `least`
    characters, or whose value is shorter than `least_value`, are dropped. It must not begin with a part that may be empty. A match with a value is name, sign (: or =), spaces and a quote, if any, and value."""

    kind: str
    expression: str
    least: int = 0
    least_value: int = 0


#: The rules whose spans every scan must report, in this order.
BASE_RULES = (
    Rule("assign", r"([Pp][Aa][Ss][Ss][Ww]([Oo][Rr])?[Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=\-]+", least_value=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{8}[0-9a-f]*", least=24),
)
#: More kinds of credentials with a fixed shape.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9\-]+", least=15),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class _Parser:
    """Thompson construction: edges[state] = [(byte set or None, state)]."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int] | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def parse(self, text: str) -> tuple[int, int]:
        self.text, self.at = text, 0
        start, end = self.choice()
        if self.at != len(text):
            raise ValueError(f"unexpected {text[self.at]!r} in {text!r}")
        return start, end

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def choice(self) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b = self.sequence()
            self.edges[start].append((None, a))
            self.edges[b].append((None, end))
            if self.peek() != "|":
                return start, end
            self.at += 1

    def sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self.peek() and self.peek() not in "|)":
            began = self.at
            a, b = self.atom()
            if self.peek() == "{":
                stop = self.text.index("}", self.at)
                times, after, atom = int(self.text[self.at + 1 : stop]), stop + 1, self.at
                for _ in range(times - 1):
                    self.at = began
                    c, d = self.atom()
                    self.edges[b].append((None, c))
                    b = d
                assert self.at == atom
                self.at = after
            elif self.peek() and self.peek() in "?*+":
                sign, self.at = self.peek(), self.at + 1
                s, e = self.state(), self.state()
                self.edges[s].append((None, a))
                self.edges[b].append((None, e))
                if sign in "?*":
                    self.edges[s].append((None, e))
                if sign in "*+":
                    self.edges[b].append((None, a))
                a, b = s, e
            self.edges[end].append((None, a))
            end = b
        return start, end

    def char(self) -> int:
        c, self.at = self.text[self.at], self.at + 1
        if c != "\\":
            return ord(c)
        c, self.at = self.text[self.at], self.at + 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def atom(self) -> tuple[int, int]:
        if self.peek() == "(":
            self.at += 1
            pair = self.choice()
            if self.peek() != ")":
                raise ValueError("missing )")
            self.at += 1
            return pair
        if self.peek() == "[":
            self.at += 1
            members: set[int] = set()
            while self.peek() != "]":
                low = high = self.char()
                if self.peek() == "-":
                    self.at += 1
                    high = self.char()
                members.update(range(low, high + 1))
            self.at += 1
        else:
            members = {self.char()}
        a, b = self.state(), self.state()
        self.edges[a].append((frozenset(members), b))
        return a, b


class Automaton:
    """Minimal deterministic automaton of some rules: step[state][byte class], classes[byte]; accepts[state] and open[state] are rule numbers.

    A rule is open in a state that holds more of it than its start: some attempt has taken a byte and may still match."""

    def __init__(self, expressions: list[str], anchored: bool):
        nfa = _Parser()
        pairs, of_rule = [], []
        for i, x in enumerate(expressions):
            pairs.append(nfa.parse(x))
            of_rule += [i] * (len(nfa.edges) - len(of_rule))
        ends = {end: i for i, (_, end) in enumerate(pairs)}
        starts = [start for start, _ in pairs]
        sets = {s for edges in nfa.edges for s, _ in edges if s is not None}
        signature = [tuple(b in s for s in sorted(sets, key=sorted)) for b in range(256)]
        names = {s: i for i, s in enumerate(dict.fromkeys(signature))}
        self.classes = bytes(names[s] for s in signature)
        sample = {self.classes[b]: b for b in range(256)}

        def close(state: int) -> set[int]:
            """States reachable without a byte, of which only those that accept or have a byte edge matter."""
            todo, seen = [state], {state}
            while todo:
                for s, to in nfa.edges[todo.pop()]:
                    if s is None and to not in seen:
                        seen.add(to)
                        todo.append(to)
            return {x for x in seen if x in ends or any(s is not None for s, _ in nfa.edges[x])}

        moves = [[(c, closed) for s, to in edges if s is not None for closed in [close(to)] for c in range(len(names)) if sample[c] in s] for edges in nfa.edges]
        again = set().union(*(close(x) for x in starts))
        first = frozenset(again)
        number, todo, step = {first: 0}, deque([first]), []
        while todo:  # subset construction
            row: list[set[int]] = [set() if anchored else set(again) for _ in names]
            for x in todo.popleft():
                for c, closed in moves[x]:
                    row[c] |= closed
            step.append([])
            for to in map(frozenset, row):
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                step[-1].append(number[to])
        accepts = [frozenset(ends[x] for x in states if x in ends) for states in number]
        opened = [frozenset(of_rule[x] for x in states - first) for states in number]
        kinds = {a: i for i, a in enumerate(dict.fromkeys(zip(accepts, opened, strict=True)))}
        group = [kinds[a] for a in zip(accepts, opened, strict=True)]
        while True:  # minimisation by refinement
            keys = [(group[i], *(group[t] for t in row)) for i, row in enumerate(step)]
            order = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            refined = [order[k] for k in keys]
            if len(order) == len(set(group)):
                break
            group = refined
        group = refined
        self.step: list[list[int]] = [[] for _ in order]
        self.accepts: list[frozenset[int]] = [frozenset()] * len(order)
        self.open: list[frozenset[int]] = [frozenset()] * len(order)
        for i, row in enumerate(step):
            self.step[group[i]] = [group[t] for t in row]
            self.accepts[group[i]], self.open[group[i]] = accepts[i], opened[i]
        self.start = group[0]


#: A byte that UTF-8 never holds: it stands between texts and leads every automaton back to its start.
BREAK = b"\xff"
CHUNK = 512


class Scanner:
    """All rules' automata."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        combined = Automaton([r.expression for r in rules], anchored=False)
        self.classes = combined.classes
        self.width, self.start = len(set(combined.classes)), combined.start
        self.table = (np.array(combined.step) * self.width).astype(np.int32).ravel()
        self.accepts = np.array([[r in a for a in combined.accepts] for r in range(len(rules))])
        self.open = np.array([[r in o for o in combined.open] for r in range(len(rules))])
        self.own = [Automaton([r.expression], anchored=True) for r in rules]
        self.dead = [{s for s, row in enumerate(a.step) if not a.accepts[s] and set(row) == {s}} for a in self.own]

    def states(self, data: bytes) -> np.ndarray:
        """The combined automaton's state after every byte, from one pass over the bytes; chunks step side by side."""
        pad = -len(data) % CHUNK
        codes = np.frombuffer((data + BREAK * pad).translate(self.classes), dtype=np.uint8)
        chunks = np.ascontiguousarray(codes.reshape(-1, CHUNK).T.astype(np.int32))
        n = chunks.shape[1]
        begin = np.full(n, self.start * self.width, dtype=np.int32)
        out = np.empty((CHUNK, n), dtype=np.int32)
        again = np.arange(n)
        while len(again):
            now, steps = begin[again], chunks[:, again]
            for t in range(CHUNK):
                now = self.table[now + steps[t]]
                out[t, again] = now
            wanted = np.concatenate([[self.start * self.width], out[-1, :-1]]).astype(np.int32)
            again = np.flatnonzero(wanted != begin)
            begin = wanted
        return out.T.ravel()[: len(data)] // self.width

    def runs(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(rule, start, end) of every run of bytes in which attempts of a rule are open and the rule accepts."""
        states = self.states(data)
        for r in range(len(self.rules)):
            hits = np.flatnonzero(self.accepts[r][states])
            if len(hits):
                shut = np.flatnonzero(~self.open[r][states])  # a run lies between two bytes after which nothing is open
                at = np.unique(np.searchsorted(shut, hits))
                for i in at.tolist():
                    yield r, int(shut[i - 1]) + 1 if i else 0, int(shut[i]) if i < len(shut) else len(data)

    def matches(self, rule: int, data: bytes) -> Iterator[tuple[int, int]]:
        """Leftmost, longest, non-overlapping matches of a rule as byte spans, before any of them is dropped."""
        a, dead = self.own[rule], self.dead[rule]
        step, accepts, start, text = a.step, a.accepts, a.start, data.translate(a.classes)
        at = 0
        while at < len(text):
            state, end, i = start, -1, at
            while i < len(text):
                state = step[state][text[i]]
                if state in dead:
                    break
                i += 1
                if accepts[state]:
                    end = i
            if end < 0:
                at += 1
            else:
                yield at, end
                at = end

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """All kept spans of each text as (kind, start, end) in code points, by start and then in the rules' order."""
        encoded = [t.encode() for t in texts]
        data = BREAK.join(encoded) + BREAK
        begins = np.cumsum([0, *(len(t) + 1 for t in encoded)])
        found: dict[int, list[tuple[int, int, int]]] = {}
        for r, a, b in self.runs(data):
            i = int(np.searchsorted(begins, a, side="right")) - 1
            for x, y in self.matches(r, data[a:b]):
                if self.keeps(r, data[a + x : a + y]):
                    found.setdefault(i, []).append((a + x - int(begins[i]), r, a + y - int(begins[i])))
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for i, spans in found.items():
            out[i] = self._in_points(texts[i], encoded[i], sorted(spans))
        return out

    def keeps(self, rule: int, match: bytes) -> bool:
        """Whether a match is long enough, and its value."""
        r = self.rules[rule]
        if len(match) < r.least:
            return False
        if not r.least_value:
            return True
        sign = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
        value = match[sign + 1 :].lstrip(b" ")
        return len(value) - (value[:1] in (b"'", b'"')) >= r.least_value

    def _in_points(self, text: str, data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
        if len(data) != len(text):
            at, n, points = 0, 0, {}
            for x in sorted({x for a, _, b in found for x in (a, b)}):
                n += len(data[at:x].decode())
                at, points[x] = x, n
            found = [(points[a], r, points[b]) for a, r, b in found]
        return [(self.rules[r].kind, a, b) for a, r, b in found]


def _batches(texts: list[str], size: int = 1 << 21) -> Iterator[list[str]]:
    """Lists of whole texts of about `size` characters."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of every whole text: the id column, spans (array of kind, start, end; code points, end exclusive)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    scanner = Scanner(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for part in _batches(texts) for x in scanner.spans(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, spans_type)], ["id", "spans"])

    out = docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span's text replaced by a mask; overlapping spans become one mask. Null texts stay null."""
    at = docs.columns.index(text_col)
    schema, scanner = docs.schema, Scanner(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, texts = batch.column(at).to_pylist(), []
            spans = [x for part in _batches([t or "" for t in whole]) for x in scanner.spans(part)]
            for t, found in zip(whole, spans, strict=True):
                merged: list[list[int]] = []
                for _, a, b in found:
                    if merged and a < merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                for a, b in reversed(merged):
                    t = t[:a] + mask + t[b:]
                texts.append(t)
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=list(batch.schema.names))

    return docs.mapInArrow(run, schema)
