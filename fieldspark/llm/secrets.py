"""Secret scans: fixed patterns, and formats inferred from the credentials that these find.

The patterns label credentials by kind. From a bounded sample of them a probabilistic automaton per kind
is inferred: a prefix tree of the labelled values whose states are merged where their outgoing
frequencies are statistically compatible. Every other string of at least the least labelled length over
the labelled alphabet is a candidate; it becomes a span where some automaton finds it much likelier than a
model of all candidates does, which is counted over the whole table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .shared import columns_apart, per_batch, stored

# The kinds in order, with pattern, the group whose length counts, and its least length.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs are maximal either way, so the least length may stand in the pattern.
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

# Strings over the alphabet of the labelled values, and what is tried where a whole one is not like them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
INNER = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9+/_.=-]*[A-Za-z0-9])?")
FRAGMENT = re.compile(r"[A-Za-z0-9+/_-]{8,}={0,2}")


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the value) of the fixed patterns, in order of start and kind."""
    out = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: Iterable[tuple[int, int, int, int]]) -> list[list[list[tuple[int, int]]]]:
    """Every candidate beside the spans already found, as steps of spans to be tried one after another.

    The steps are the whole string, the string without signs at its ends, and its parts between dots and
    equal signs. All spans have at least 8 characters.
    """
    busy = sorted((s, e) for s, _, e, _ in taken)
    out, i = [], 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while i < len(busy) and busy[i][1] <= at:
            i += 1
        k = i
        while at < end:
            while k < len(busy) and busy[k][1] <= at:
                k += 1
            stop = min(end, busy[k][0]) if k < len(busy) else end
            if stop - at >= LEAST_ASSIGN:
                steps = [[(at, stop)]]
                inner = INNER.search(text, at, stop)
                if inner and LEAST_ASSIGN <= inner.end() - inner.start() < stop - at:
                    steps.append([inner.span()])
                parts = [p.span() for p in FRAGMENT.finditer(text, at, stop) if [p.span()] not in steps]
                out.append([*steps, parts] if parts else steps)
            at = max(stop, busy[k][1]) if k < len(busy) else end
    return out


def symbol(c: str) -> str:
    """Characters by class: digits, hexadecimal and other lower-case letters, capitals, and signs as they are."""
    if c.isdigit():
        return "9"
    if "a" <= c <= "z":
        return "f" if c <= "f" else "z"
    return "A" if "A" <= c <= "Z" else c


# Symbols of all characters that a candidate may have.
CLASSES = {i: symbol(chr(i)) for i in range(128)}
# Characters in a class, which share its probability.
CLASS_SIZES = {"9": 10, "f": 6, "z": 20, "A": 26}


@dataclass
class Automaton:
    """Probabilistic automaton: per state the log-probability of its end, and per symbol that of the step and the next state."""

    ends: list[float]
    steps: list[dict[str, tuple[float, int]]]

    def log_likelihood(self, value: str) -> float:
        """Per character, with the end; unknown steps cost a fixed amount and keep the state."""
        state, total = 0, 0.0
        for c in value:
            s = symbol(c)
            found = self.steps[state].get(s)
            total -= math.log(CLASS_SIZES.get(s, 1))
            if found is None:
                total += UNKNOWN
            else:
                total += found[0]
                state = found[1]
        return (total + self.ends[state]) / (len(value) + 1)


UNKNOWN = math.log(1e-4)


def inferred(values: Iterable[str], alpha: float = 0.05) -> Automaton:
    """State merging on the prefix tree of ``values``, in the order of the states' distance from the root.

    Two states are compatible if, for their ends and every symbol, the shares differ by less than the
    bound of Hoeffding at ``alpha``, and so for the states that equal symbols lead to; the bound is wide for
    states that few values reach. A state is folded into the first that it is compatible with, and stays by
    itself where there is none. No values: an automaton that ends.
    """
    children: list[dict[str, int]] = [{}]
    passed, ended = [0], [0]
    for v in values:
        node = 0
        passed[0] += 1
        for c in v:
            s = symbol(c)
            if s not in children[node]:
                children[node][s] = len(children)
                children.append({})
                passed.append(0)
                ended.append(0)
            node = children[node][s]
            passed[node] += 1
        ended[node] += 1
    into = list(range(len(children)))
    factor = math.sqrt(0.5 * math.log(2 / alpha))

    def root(n: int) -> int:
        while into[n] != n:
            into[n] = into[into[n]]
            n = into[n]
        return n

    steps: list[dict[str, int]] = [{s: passed[c] for s, c in kids.items()} for kids in children]

    def compatible(a: int, b: int) -> bool:
        # To the end of the tree: b's side is one, whatever has been merged on the side of a.
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            x, y = root(x), root(y)
            n, m = passed[x], passed[y]
            if x == y or not n or not m:
                continue
            bound = factor * (n**-0.5 + m**-0.5)
            if abs(ended[x] / n - ended[y] / m) > bound:
                return False
            for s in children[x].keys() | children[y].keys():
                if abs(steps[x].get(s, 0) / n - steps[y].get(s, 0) / m) > bound:
                    return False
                if s in children[x] and s in children[y]:
                    todo.append((children[x][s], children[y][s]))
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            x, y = root(x), root(y)
            if x == y:
                continue
            into[y] = x
            passed[x] += passed[y]
            ended[x] += ended[y]
            for s, n in steps[y].items():
                steps[x][s] = steps[x].get(s, 0) + n
            for s, child in children[y].items():
                if s in children[x]:
                    todo.append((children[x][s], child))
                else:
                    children[x][s] = child

    red = [0]
    blue = sorted(children[0].values())
    while blue:
        q = root(blue.pop(0))
        red = list(dict.fromkeys(map(root, red)))
        if q in red:
            continue
        for r in red:
            if compatible(r, q):
                fold(r, q)
                break
        else:
            red.append(q)
        red = list(dict.fromkeys(map(root, red)))
        blue = sorted({root(c) for r in red for c in children[r].values()} - set(red))
    number = {r: i for i, r in enumerate(red)}
    ends, out = [], []
    for r in red:
        kinds = len(steps[r]) + 1
        total = passed[r] + 0.1 * kinds
        ends.append(math.log((ended[r] + 0.1) / total))
        out.append({s: (math.log((n + 0.1) / total), number[root(children[r][s])]) for s, n in steps[r].items()})
    return Automaton(ends, out)


# Symbols that a state of the background remembers; with 10 symbols, at most 11,111 states and 122,221 counts.
MEMORY = 4


def transitions(classes: str) -> list[str]:
    """The steps of a string of symbols through the background: up to MEMORY symbols before, and the next one or $.

    ``^`` stands before the first symbol.
    """
    marked = f"^{classes}$"
    return [marked[max(0, i - MEMORY) : i + 1] for i in range(1, len(marked))]


def counted(counts: dict[str, int]) -> Automaton:
    """The automaton of counted :func:`transitions`; no counts: an automaton for any string."""
    if not counts:
        return Automaton([math.log(0.02)], [{s: (math.log(0.98 / 5), 0) for s in "9fzA-"}])
    by_state: dict[str, dict[str, int]] = {"^": {}}
    for gram, n in sorted(counts.items()):
        by_state.setdefault(gram[:-1], {})[gram[-1]] = n
    number = {state: i for i, state in enumerate(by_state)}
    ends, steps = [], []
    for state, found in by_state.items():
        total = sum(found.values()) + 0.1 * (len(found) + 1)
        ends.append(math.log((found.get("$", 0) + 0.1) / total))
        steps.append({s: (math.log((n + 0.1) / total), number[(state + s)[-MEMORY:]]) for s, n in found.items() if s != "$"})
    return Automaton(ends, steps)


@dataclass
class SecretModel:
    """Automata by kind, the model of all candidates, and the least lead of the likelihood over it."""

    automata: dict[str, Automaton]
    background: Automaton
    least: dict[str, float]

    def kind_of(self, value: str) -> str | None:
        """The kind whose automaton leads most, if the lead reaches its least value."""
        base = self.background.log_likelihood(value)
        leads = {k: a.log_likelihood(value) - base for k, a in self.automata.items()}
        fit = [k for k in leads if leads[k] >= self.least[k]]
        return max(fit, key=lambda k: (leads[k], k)) if fit else None


def fit_model(labelled: dict[str, list[str]], background: Automaton, least_examples: int = 20, margin: float = 0.25) -> SecretModel:
    """Kinds with too few labelled values have no automaton. A kind's least lead is that which 95 of 100
    labelled values reach, and at least ``margin`` per character."""
    automata = {k: inferred(v) for k, v in sorted(labelled.items()) if len(v) >= least_examples}
    least = {}
    for k, a in automata.items():
        leads = sorted(a.log_likelihood(v) - background.log_likelihood(v) for v in labelled[k])
        least[k] = max(margin, leads[len(leads) // 20])
    return SecretModel(automata, background, least)


FOUND = "kind int, value string, n long"
# Strings of symbols that a task remembers at once.
MOST_KNOWN = 1 << 17


def found_strings(docs: DataFrame) -> DataFrame:
    """The labelled values of all whole texts by kind, and with kind -1 the counted transitions of all candidates."""

    def table_of(rows: list[tuple[int, str, int]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.int64()))], names=["kind", "value", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: Counter[str] = Counter()
        strings: Counter[str] = Counter()

        def add() -> None:
            for classes, n in strings.items():
                for gram in transitions(classes):
                    grams[gram] += n
            strings.clear()

        for batch in batches:
            values: Counter[tuple[int, str]] = Counter()
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                values.update((k, text[v:e]) for _, k, e, v in base)
                strings.update(text[s:e].translate(CLASSES) for steps in candidates(text, base) for step in steps for s, e in step)
                if len(strings) > MOST_KNOWN:
                    add()
            if values:
                yield table_of([(k, v, n) for (k, v), n in values.items()])
        add()
        if grams:
            yield table_of([(-1, gram, n) for gram, n in grams.items()])

    return columns_apart(docs, ["text"]).mapInArrow(run, FOUND)


def infer_formats(found: DataFrame, examples: int = 400, longest: int = 80) -> SecretModel:
    """Automata from at most ``examples`` labelled values per kind, the distinct ones with the smallest hashes.

    Values longer than ``longest`` are no examples, but are scored like all others. The background has the
    counts of all candidates.
    """

    def sample(kind: int) -> list[str]:
        rows = found.filter((F.col("kind") == kind) & F.length("value").between(8, longest)).select("value").distinct()
        return [r[0] for r in rows.orderBy(F.xxhash64("value"), "value").limit(examples).collect()]

    counts = found.filter("kind = -1").groupBy("value").agg(F.sum("n").alias("n")).collect()
    return fit_model({name: sample(i) for i, name in enumerate(KINDS)}, counted({r["value"]: r["n"] for r in counts}))


def inferred_spans(text: str, base: list[tuple[int, int, int, int]], model: SecretModel, known: dict[str, str | None]) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the candidates like labelled values; of each, the first step that has any."""
    out = []
    for steps in candidates(text, base):
        for step in steps:
            hits = []
            for s, e in step:
                classes = text[s:e].translate(CLASSES)
                if classes not in known:
                    if len(known) >= MOST_KNOWN:
                        known.clear()
                    # The likelihood depends on the symbols alone.
                    known[classes] = model.kind_of(text[s:e])
                if known[classes] is not None:
                    hits.append((s, known[classes], e))
            if hits:
                out += hits
                break
    return out


def secret_spans(docs: DataFrame, examples: int = 400) -> DataFrame:
    """``doc_id, spans`` per row: an array of (kind, start, end, inferred), in order of start and kind.

    Offsets count code points, ends are exclusive. Pattern spans are always there; inferred ones have the
    kind of the automaton and overlap none of them. A null text counts as empty and has no spans; null and
    repeated ids are kept, other columns are ignored, whole texts of any length are read, and an empty table gives an empty
    result.
    """
    rows = columns_apart(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = infer_formats(stored(found_strings(rows), "secret-strings"), examples)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("inferred", pa.bool_())]))
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                spans = [(s, k, e, False) for s, k, e, _ in base]
                spans += [(s, KINDS.index(k), e, True) for s, k, e in inferred_spans(text or "", base, model, known)]
                out.append([{"kind": KINDS[k], "start": s, "end": e, "inferred": i} for s, k, e, i in sorted(spans)])
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,inferred:boolean>>")


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redacted(docs: DataFrame, examples: int = 400, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of :func:`secret_spans` replaced by ``mask``; all rows and columns stay.

    Of spans that overlap, the union is replaced once. Null texts stay null, empty ones empty, and whole texts of any
    length are read. ``n_chars``, where there is one that is a number, counts the new text; other columns, of
    any name and type, stay as they are. An empty table gives an empty result.
    """
    model = infer_formats(stored(found_strings(docs), "secret-strings"), examples)

    known: dict[str, str | None] = {}

    def masked(text: str) -> str:
        base = base_spans(text)
        spans = [(s, e) for s, _, e, _ in base] + [(s, e) for s, _, e in inferred_spans(text, base, model, known)]
        parts, at = [], 0
        for s, e in sorted(spans):
            if e > at:
                if s >= at:
                    parts += [text[at:s], mask]
                at = e
        return "".join([*parts, text[at:]]) if spans else text

    def run(column: pa.Array) -> pa.Array:
        return pa.array([masked(t) if t else t for t in column.to_pylist()], pa.string())

    new = {"text": F.arrow_udf(run, "string")(F.col("text"))}
    out = docs.withColumns(new)
    if "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, NumericType):
        out = out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return out
