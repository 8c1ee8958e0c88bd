"""Secret scans by combined deterministic automata over bytes.

Rules are regular expressions over bytes. Each also has cores (expressions of one length that every match
starts with). Thompson positions, subset construction and partition refinement turn them into two flat
transition arrays: one of all rules' cores, which may start anywhere, and one of all rules' whole
expressions, which start where a core does. The first reads a text once, byte by byte, for all rules.
From a core's start the second gives each rule's longest end. Its walks remember their state at every
64th byte: one that comes to the state of an earlier one stops there and has its ends, so that a text in
which cores follow each other densely is still read in linear time.

Per rule, matches are leftmost and do not overlap. A match that a rule's filter refuses is dropped,
but its bytes stay used up. Offsets are code points, end exclusive. Null and empty texts have no
spans. Equal rows give equal results; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbgrid.llm.common import map_rows, only

BYTES = frozenset(range(256))
#: Places at which walks remember their state: multiples of this power of two.
STOP = 64


@dataclass(frozen=True)
class Rule:
    """kind: name of its spans. cores, whole: expressions over bytes; fold: letters in either case."""

    kind: str
    cores: tuple[str, ...]
    whole: str
    fold: bool = False


#: A private key: from its header to its END line, if no other five dashes come before; else header fields
#: and base64 lines after the header (breaks may be escapes; a short last line follows long ones only).
_PEM = (
    r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----((-{0,4}[^-])*-----END ([A-Z0-9]+ )*PRIVATE KEY-----"
    r"|((\r?\n|(\\r)?\\n)[ \t]*[A-Z][A-Za-z]*-[A-Za-z-]*: [^\r\n\\]*)*((([ \t\r\n]|\\r|\\n)*[A-Za-z0-9+/=]{16,})+((\r?\n|(\\r)?\\n)[ \t]*[A-Za-z0-9+/=]{1,15})?)?)"
)
#: The base kinds, in their order, then the kinds this method adds.
RULES = (
    Rule("assign", ("password", "passwd", "secret", "token", "api_key", "apikey"), r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]+""", fold=True),
    Rule("access", ("AKIA",), "AKIA[A-Z0-9]+"),
    Rule("hex", ("[0-9a-f]{16}",), "[0-9a-f]+"),
    Rule("github", ("gh[pousr]_",), "gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", ("xox[abprs]-",), "xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("jwt", ("eyJ",), r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("pem", ("-----BEGIN ",), _PEM),
)
BASE = ("assign", "access", "hex")
KINDS = tuple(r.kind for r in RULES)
_VALUE = re.compile(rb"""[a-z_]+["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)\Z""", re.I)


def kept(kind: str, match: bytes) -> bool:
    """A rule's filter on a whole match."""
    if kind == "assign":
        return len(_VALUE.match(match)[1]) >= 12
    return kind != "access" or len(match) >= 18


#: What an escaped letter stands for in a rule; other escaped characters are themselves.
_ESCAPES = {"n": 10, "r": 13, "t": 9}
_DIGITS = re.compile("[0-9]*")


class Expression:
    """A rule's expression as a tree: ("set", bytes), ("all", parts), ("one", options) or
    ("many", part, low, high). Known are literals, escapes, classes, groups, | and ? * + {m} {m,n}."""

    def __init__(self, text: str, fold: bool = False) -> None:
        self.text, self.at, self.fold = text, 0, fold
        self.tree = self.options()
        if self.at < len(text):
            raise ValueError(f"unexpected {text[self.at]} at {self.at} in a rule")

    def next_is(self, some: str) -> bool:
        return self.at < len(self.text) and self.text[self.at] in some

    def take(self) -> str:
        if self.at == len(self.text):
            raise ValueError("a rule ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def options(self) -> tuple:
        out = [self.sequence()]
        while self.next_is("|"):
            self.take()
            out.append(self.sequence())
        return out[0] if len(out) == 1 else ("one", out)

    def sequence(self) -> tuple:
        out = []
        while self.at < len(self.text) and not self.next_is("|)"):
            part = self.part()
            while self.next_is("?*+{"):
                part = ("many", part, *self.times())
            out.append(part)
        return ("all", out)

    def times(self) -> tuple[int, int | None]:
        mark = self.take()
        if mark != "{":
            return int(mark == "+"), 1 if mark == "?" else None
        low = self.number()
        high = low
        if self.next_is(","):
            self.take()
            high = self.number() if not self.next_is("}") else None
        if self.take() != "}":
            raise ValueError("a count in a rule does not end")
        return low, high

    def number(self) -> int:
        m = _DIGITS.match(self.text, self.at)
        self.at = m.end()
        return int(m[0])

    def part(self) -> tuple:
        c = self.take()
        if c == "(":
            out = self.options()
            if self.take() != ")":
                raise ValueError("a group in a rule does not end")
            return out
        if c == ".":
            return ("set", BYTES - {10})
        if c == "[":
            return ("set", self.members())
        if c in "?*+{":
            raise ValueError(f"nothing for {c} in a rule")
        return ("set", self.folded({self.byte(c)}))

    def byte(self, c: str) -> int:
        if c == "\\":
            c = self.take()
            return _ESCAPES.get(c, ord(c))
        if not c.isascii():
            raise ValueError("rules are ASCII")
        return ord(c)

    def members(self) -> frozenset[int]:
        out: set[int] = set()
        negated = self.next_is("^") and bool(self.take())
        while not self.next_is("]"):
            low = high = self.byte(self.take())
            if self.next_is("-") and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.take()
                high = self.byte(self.take())
            out |= set(range(low, high + 1))
        self.take()
        return BYTES - self.folded(out) if negated else self.folded(out)

    def folded(self, some: set[int]) -> frozenset[int]:
        return frozenset(some | {b ^ 32 for b in some if chr(b).isascii() and chr(b).isalpha()} if self.fold else some)


def width(tree: tuple) -> int:
    """The one length of what an expression matches."""
    if tree[0] == "set":
        return 1
    if tree[0] == "all":
        return sum(map(width, tree[1]))
    if tree[0] == "many" and tree[2] == tree[3]:
        return tree[2] * width(tree[1])
    if tree[0] == "one" and len(lengths := set(map(width, tree[1]))) == 1:
        return lengths.pop()
    raise ValueError("a core has one length")


class Nfa:
    """Positions with byte and empty moves."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def new(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, tree: tuple, at: int) -> int:
        """Moves for an expression from position at; returns where it ends."""
        kind, what = tree[:2]
        if kind == "set":
            to = self.new()
            self.moves[at].append((what, to))
            return to
        if kind == "all":
            for part in what:
                at = self.add(part, at)
            return at
        end = self.new()
        if kind == "one":
            for option in what:
                start = self.new()
                self.empty[at].append(start)
                self.empty[self.add(option, start)].append(end)
            return end
        low, high = tree[2:]
        for _ in range(low):
            at = self.add(what, at)
        if high is None:
            loop = self.new()
            self.empty[at] += [loop, end]
            self.empty[self.add(what, loop)] += [loop, end]
        else:
            for _ in range(high - low):
                self.empty[at].append(end)
                at = self.add(what, at)
            self.empty[at].append(end)
        return end

    def closure(self, some) -> frozenset[int]:
        seen, todo = set(some), list(some)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def byte_classes(nfa: Nfa) -> list[int]:
    """A number for each byte, alike for bytes that all moves take alike."""
    out = [0] * 256
    for some in {some for moves in nfa.moves for some, _ in moves}:
        names: dict = {}
        out = [names.setdefault((c, b in some), len(names)) for b, c in enumerate(out)]
    return out


def determinise(nfa: Nfa, start: int, ends: dict[int, int], anywhere: bool) -> tuple[list[list[int]], list[frozenset[int]]]:
    """Subset construction over byte classes; ends has the mark of each accepting position. State 0 starts;
    where no position is left, the state is -1 (with anywhere, matches may start at every byte)."""
    classes = byte_classes(nfa)
    samples = [classes.index(c) for c in range(max(classes) + 1)]
    first = nfa.closure([start])
    numbers, todo, rows, marks = {first: 0}, [first], [], []
    for state in todo:
        moves = [move for at in state for move in nfa.moves[at]]
        row, memo = [], {}
        for b in samples:
            key = frozenset(x for some, x in moves if b in some)
            if key not in memo:
                memo[key] = nfa.closure(key | ({start} if anywhere else set()))
            nxt = memo[key]
            if nxt and nxt not in numbers:
                numbers[nxt] = len(numbers)
                todo.append(nxt)
            row.append(numbers[nxt] if nxt else -1)
        rows.append(row)
        marks.append(frozenset(ends[at] for at in state if at in ends))
    return rows, marks


def minimise(rows: list[list[int]], marks: list[frozenset[int]]) -> tuple[list[list[int]], list[frozenset[int]]]:
    """Partition refinement: states with equal marks are split until all bytes lead alike."""
    names: dict = {}
    part = [names.setdefault(m, len(names)) for m in marks]
    while True:
        keys: dict = {}
        part.append(-1)  # where -1 leads
        new = [keys.setdefault((part[s], *[part[x] for x in row]), len(keys)) for s, row in enumerate(rows)]
        if len(keys) == len(set(part)) - 1:
            break
        part = new
    first = {p: s for s, p in reversed(list(enumerate(new)))}
    order = sorted(first, key=lambda p: (p != new[0], bool(marks[first[p]]), p))  # the start is 0, accepting states are last
    at = {p: k for k, p in enumerate(order)}
    return [[at[new[x]] if x >= 0 else -1 for x in rows[first[p]]] for p in order], [marks[first[p]] for p in order]


class Automaton:
    """All cores in one flat array, all whole expressions in another."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules, self.cores = rules, []
        nfa, ends = Nfa(), {}
        start = nfa.new()
        for r, rule in enumerate(rules):
            for core in rule.cores:
                tree = Expression(core, rule.fold).tree
                ends[nfa.add(tree, start)] = len(self.cores)
                self.cores.append((r, width(tree)))
        self.array, self.accepting, self.marks = self._flat(nfa, start, ends, True)
        self.states = len(self.array) // 256
        nfa, ends = Nfa(), {}
        start = nfa.new()
        for r, rule in enumerate(rules):
            own = nfa.new()
            nfa.empty[start].append(own)
            ends[nfa.add(Expression(rule.whole, rule.fold).tree, own)] = r
        self.wholes, self.ending, self.ends = self._flat(nfa, start, ends, False)

    @staticmethod
    def _flat(nfa: Nfa, start: int, ends: dict[int, int], anywhere: bool) -> tuple[list[int], int, dict[int, list[int]]]:
        """Transitions by state + byte (states are multiples of 256, none is -1), the first accepting
        state, and the marks of each."""
        rows, marks = minimise(*determinise(nfa, start, ends, anywhere))
        first = next((k for k, m in enumerate(marks) if m), len(rows))
        classes = byte_classes(nfa)
        return [256 * row[c] if row[c] >= 0 else -1 for row in rows for c in classes], 256 * first, {256 * k: sorted(m) for k, m in enumerate(marks) if m}

    def longest(self, data: bytes, at: int, seen: dict[tuple[int, int], dict[int, int]]) -> dict[int, int]:
        """The longest end of each rule's match that starts at a byte. seen: (place, state) of earlier
        walks over these data and the ends that they came to."""
        array, ending, state, ends = self.wholes, self.ending, 0, {}
        for i in range(at, len(data)):
            if not i % STOP:
                if (i, state) in seen:
                    ends.update({r: e for r, e in seen[i, state].items() if e > i})
                    break
                seen[i, state] = ends
            state = array[state + data[i]]
            if state >= ending:
                for r in self.ends[state]:
                    ends[r] = i + 1
            elif state < 0:
                break
        return ends

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, all rules, by start and rule."""
        array, accepting, state, events = self.array, self.accepting, 0, []
        for i, b in enumerate(data):
            state = array[state + b]
            if state >= accepting:
                events.append((i, state))
        out, used, seen = [], [0] * len(self.rules), {}
        for i, state in events:
            for core in self.marks[state]:
                rule, length = self.cores[core]
                start = i + 1 - length
                if start >= used[rule] and (end := self.longest(data, start, seen).get(rule)):
                    used[rule] = end
                    if kept(self.rules[rule].kind, data[start:end]):
                        out.append((start, rule, end))
        return sorted(out)


def scan(text: str | None, automaton: Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found = automaton.spans(data)
    if not found:
        return []
    if data.isascii():
        place = lambda x: x
    else:
        cuts = sorted({x for s, _, e in found for x in (s, e)})
        points, last, n = {}, 0, 0
        for x in cuts:
            n += len(data[last:x].decode("utf-8", "surrogatepass"))
            points[x] = n
            last = x
        place = points.get
    return [(automaton.rules[r].kind, place(s), place(e)) for s, r, e in found]


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: key and spans array<struct<kind,start,end>>, by start and then rule order."""

    held = docs.sparkSession.sparkContext.broadcast(Automaton(rules))

    def make() -> Callable:
        automaton = held.value
        return lambda columns: ((k, scan(t, automaton)) for k, t in zip(*columns))

    return map_rows(only(docs, **{key: "long", text: "string"}), f"{key} long, spans array<struct<kind:string,start:long,end:long>>", make)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret replaced by <secret>, overlapping spans as one; n_chars, where there is
    one, follows. Rows without secrets stay as they are, null texts too."""

    held = docs.sparkSession.sparkContext.broadcast(Automaton(rules))

    def make() -> Callable:
        automaton = held.value

        def clean(t: str | None) -> str | None:
            out, at = [], 0
            for _, s, e in scan(t, automaton):
                if e > at:
                    if s >= at:
                        out += [t[at:s], "<secret>"]
                    at = e
            return "".join([*out, t[at:]]) if out else t

        return lambda columns: ((*row[:-1], clean(row[-1])) for row in zip(*columns))

    names = [x for x in docs.columns if x != "text"]
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    schema = T.StructType([T.StructField(x, kinds[x]) for x in names] + [T.StructField("text", T.StringType())])
    out = map_rows(docs.select(*[F.col(f"`{x}`") for x in names], "text"), schema, make)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kinds["n_chars"]), "n_chars"))
    return out.select(*[F.col(f"`{x}`") for x in docs.columns])


def digest_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = secret_spans(docs)
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, one), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))
