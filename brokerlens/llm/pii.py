"""Personal data: fixed patterns, and a semi-Markov conditional random field over candidate segments."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brokerlens.llm.common import per_batch, slices

KINDS = ["email", "ip", "card", "phone"]
Span = tuple[str, int, int]

# Fixed patterns. None of them walks a run of characters more than once.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def octet(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield "email", start, last
        at = text.find("@", max(last, at + 1))


def base_spans(text: str) -> list[Span]:
    """The matches of the fixed patterns that hold, by start, then kind."""
    out = list(_emails(text))
    for m in IP.finditer(text):
        if all(map(octet, m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = digits_of(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=_place)


def _place(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


# Candidate segments

RUN = re.compile(r"[+(]{0,2}[0-9]++(?:[ ().+-]{1,3}+[0-9]++)*+")
GROUP = re.compile(r"[0-9]+")
ADDRESS = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}+){1,8}"
)
MARK = re.compile(r"@|\(at\)|\[at\]")
MOST_GROUPS = 8
NUMERIC = ["ip", "card", "phone"]


class Region:
    """Digit groups that separators of a few characters hold together, or one address; and its candidates.

    A candidate is a run of at most ``MOST_GROUPS`` groups, with what is known of the whole span.
    """

    def __init__(self, text: str, start: int, end: int, address: bool):
        self.text, self.start, self.address = text, start, address
        if address:
            self.groups = [(start, end)]
        else:
            self.groups = [m.span() for m in GROUP.finditer(text, start, end)]

    def bounds(self, i: int, j: int) -> tuple[int, int]:
        """Where the segment of groups i to j lies: with a plus or parenthesis in front, if it is its own."""
        start, end = self.groups[i][0], self.groups[j][1]
        floor = self.groups[i - 1][1] if i else self.start
        while start > floor and self.text[start - 1] in "+(" and self.groups[i][0] - start < 2:
            start -= 1
        return start, end

    def features(self, i: int, j: int) -> list[str]:
        start, end = self.bounds(i, j)
        span = self.text[start:end]
        if self.address:
            sign = MARK.search(span).group()
            labels = re.split(r" ?(?:\.|\(dot\)|\[dot\]) ?", span[span.index(sign) + len(sign):])
            tail = labels[-1]
            return [
                "sign " + sign, f"labels {min(len(labels), 4)}", f"spaces {' ' in span}",
                f"tail {tail.isalpha()} {min(len(tail), 5)}",
            ]
        groups = [self.text[a:b] for a, b in self.groups[i : j + 1]]
        n = sum(map(len, groups))
        between = {self.text[a:b] for (_, a), (b, _) in zip(self.groups[i:j], self.groups[i + 1 : j + 1])}
        glue = "none" if not between else "dots" if between == {"."} else "plain" if between <= {" ", "-"} else "mixed"
        plus = span.startswith("+")
        octets = len(groups) == 4 and glue == "dots" and all(map(octet, groups))
        check = 14 <= n <= 19 and luhn("".join(groups))
        length = "short" if n < 10 else "phone" if n < 14 else "both" if n < 16 else "card" if n < 20 else "long"
        return [
            f"groups {min(len(groups), 6)}", f"length {length}", f"glue {glue}", f"plus {plus} {length}",
            f"inner plus {'+' in span[1:]}", f"octets {octets}", f"check {check} {glue}", f"check {check} {plus} {length}",
            f"closed {span.count('(') == span.count(')')}",
        ]

    def lattice(self) -> list[tuple[int, int, list[str]]]:
        """(first group, last group, features) of every candidate; short single groups are none."""
        n, out = len(self.groups), []
        for i in range(n):
            digits = 0
            for j in range(i, min(n, i + MOST_GROUPS)):
                digits += self.groups[j][1] - self.groups[j][0]
                if self.address or digits >= 10 or (j - i == 3 and digits <= 12):
                    if not self.address and digits > 19:
                        break
                    out.append((i, j, self.features(i, j)))
        return out


def regions(text: str) -> list[Region]:
    out = []
    for m in RUN.finditer(text):
        if m.end() - m.start() >= 7 and (m.end() - m.start() >= 10 or "." in m.group()):
            out.append(Region(text, *m.span(), False))
    if MARK.search(text):
        out += [Region(text, *m.span(), True) for m in ADDRESS.finditer(text)]
    return out


def _gold(region: Region, base: list[Span]) -> list[tuple[int, int, str]] | None:
    """The base spans as segments of the region; None where the patterns are no teacher.

    They are none where a match was dropped for having too many digits (entities run into each other), where spans
    overlap or where one does not end at group bounds.
    """
    first, last = region.start, region.groups[-1][1]
    if not region.address:
        text = region.text[first:last]
        if any(len(digits_of(m.group())) > 15 for m in PHONE.finditer(text)):
            return None
        if any(len(digits_of(m.group())) > 19 for m in CARD.finditer(text)):
            return None
    out, end = [], -1
    for kind, a, b in base:
        if b <= first or a >= last or (kind == "email") != region.address:
            continue
        i = next((k for k in range(len(region.groups)) if region.bounds(k, k)[0] == a), None)
        j = next((k for k, (_, g) in enumerate(region.groups) if g == b), None)
        if i is None or j is None or i <= end or j - i >= MOST_GROUPS:
            return None
        out.append((i, j, kind))
        end = j
    return out


def _lessons(texts: list) -> dict:
    found: dict[str, int] = defaultdict(int)
    for text in texts:
        near = regions(text) if text else []
        if not near:
            continue
        base = base_spans(text)
        for region in near:
            gold = _gold(region, base) if len(region.groups) <= 4 * MOST_GROUPS else None
            if gold is not None:
                shape = [g[1] - g[0] for g in region.groups] if not region.address else [0]
                found[json.dumps([region.address, shape, region.lattice(), gold])] += 1
    return {"lesson": list(found), "n": list(found.values())}


# The field


class Field:
    """Weights of a semi-Markov conditional random field.

    A labelling cuts a region's groups into segments, each of a kind or, one group long, of none. Its score is the
    sum of the weights of each segment's features and of each pair of neighbouring kinds.
    """

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def segments(self, address: bool, shape: list[int], lattice: list) -> list[list[tuple[int, str, list[str]]]]:
        """By last group: (first group, kind, names of weights)."""
        ends: list[list[tuple[int, str, list[str]]]] = [
            [(j, "none", ["none", f"none {address}", f"none {min(size, 20)}"])] for j, size in enumerate(shape)
        ]
        for i, j, features in lattice:
            for kind in ["email"] if address else NUMERIC:
                ends[j].append((i, kind, [kind, *(f"{kind} {f}" for f in features)]))
        return ends

    def _value(self, names: list[str]) -> float:
        return sum(self.weights.get(n, 0.0) for n in names)

    def best(self, address: bool, shape: list[int], lattice: list) -> list[tuple[int, int, str]]:
        """The segments of the best labelling that are of a kind."""
        ends = self.segments(address, shape, lattice)
        best: list[dict[str, tuple[float, int, str]]] = [{"start": (0.0, -1, "")}]
        for j, own in enumerate(ends):
            here: dict[str, tuple[float, int, str]] = {}
            for i, kind, names in own:
                value = self._value(names)
                for before, (score, _, _) in best[i].items():
                    total = score + value + self.weights.get(f"{before} > {kind}", 0.0)
                    if kind not in here or total > here[kind][0]:
                        here[kind] = (total, i, before)
            best.append(here)
        out, at = [], len(ends)
        kind = max(best[at], key=lambda k: (best[at][k][0], k))
        while at:
            _, i, before = best[at][kind]
            if kind != "none":
                out.append((i, at - 1, kind))
            at, kind = i, before
        return out[::-1]

    def gradient(self, address: bool, shape: list[int], lattice: list, gold: list, out: dict, n: int) -> float:
        """Adds n times (observed less expected features); gives n times the log-likelihood."""
        ends = self.segments(address, shape, lattice)
        values = [[self._value(names) for _, _, names in own] for own in ends]
        step = self.weights.get

        def add(a: float, b: float) -> float:
            top, low = (a, b) if a > b else (b, a)
            return top + math.log1p(math.exp(low - top)) if low > -math.inf else top

        size = len(ends)
        forward: list[dict[str, float]] = [{"start": 0.0}]
        for own, score in zip(ends, values):
            here: dict[str, float] = {}
            for (i, kind, _), value in zip(own, score):
                for before, f in forward[i].items():
                    here[kind] = add(here.get(kind, -math.inf), f + value + step(f"{before} > {kind}", 0.0))
            forward.append(here)
        total = -math.inf
        for f in forward[size].values():
            total = add(total, f)
        backward: list[dict[str, float]] = [{} for _ in range(size + 1)]
        backward[size] = dict.fromkeys(forward[size], 0.0)
        for j in range(size - 1, -1, -1):
            for (i, kind, names), value in zip(ends[j], values[j]):
                after = backward[j + 1].get(kind)
                if after is None:
                    continue
                for before, f in forward[i].items():
                    pair = f"{before} > {kind}"
                    whole = value + step(pair, 0.0) + after
                    backward[i][before] = add(backward[i].get(before, -math.inf), whole)
                    p = n * math.exp(min(0.0, f + whole - total))
                    for name in [*names, pair]:
                        out[name] -= p
        wanted, at = {(i, j): kind for i, j, kind in gold}, 0
        gained, before = 0.0, "start"
        while at < size:
            i, j, kind = next(((i, j, k) for (i, j), k in wanted.items() if i == at), (at, at, "none"))
            chosen = [(names, v) for (a, k, names), v in zip(ends[j], values[j]) if a == i and k == kind]
            if not chosen:
                return 0.0
            names, value = chosen[0]
            pair = f"{before} > {kind}"
            gained += value + step(pair, 0.0)
            for name in [*names, pair]:
                out[name] += n
            at, before = j + 1, kind
        return n * (gained - total)


def _reachable(lesson: list) -> bool:
    held = {(i, j) for i, j, _ in lesson[2]}
    return all((i, j) in held for i, j, _ in lesson[3])


def train(lessons: list[tuple[str, int]], rounds: int = 60, rate: float = 0.5, penalty: float = 0.02) -> Field:
    """Penalised maximum likelihood by adaptive gradient steps; copies of a lesson weigh by the root of their number."""
    field, squares = Field(), defaultdict(float)
    known = [(json.loads(text), math.sqrt(n)) for text, n in lessons]
    known = [(lesson, n) for lesson, n in known if _reachable(lesson)]
    for _ in range(rounds if known else 0):
        slope: dict[str, float] = defaultdict(float)
        for (address, shape, lattice, gold), n in known:
            field.gradient(address, shape, lattice, gold, slope, n)
        for name, g in slope.items():
            g -= penalty * field.weights.get(name, 0.0)
            squares[name] += g * g
            if squares[name] > 0:
                field.weights[name] = field.weights.get(name, 0.0) + rate * g / math.sqrt(squares[name])
    return field


def fit(docs: DataFrame, text: str = "text", most_lessons: int = 1500) -> Field:
    """A field taught by the fixed patterns where they are unambiguous.

    Regions of all documents are reduced to their candidates' features with the patterns' answer and counted; the
    ``most_lessons`` most frequent different ones train the field. Without any, the field finds nothing.
    """
    schema = T.StructType().add("lesson", "string").add("n", "long")
    rows = docs.select(F.col(text).alias("text")).where(F.col("text").rlike(r"[0-9][0-9 ().+-]{5}|@|\(at\)|\[at\]"))
    counts = rows.mapInArrow(per_batch(_lessons, ["text"], schema), schema).groupBy("lesson").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "lesson").limit(most_lessons).collect()
    return train([(r["lesson"], r["n"]) for r in top])


def _holds(kind: str, span: str) -> bool:
    """An exact check of what the field has chosen."""
    digits = digits_of(span)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return span[0] == "+" and 10 <= len(digits) <= 15 and "+" not in span[1:] and span.count("(") == span.count(")")
    if kind == "ip":
        parts = span.split(".")
        return len(parts) == 4 and all(p.isdigit() and octet(p) for p in parts)
    return True


def find(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """(spans of the fixed patterns, these and the ones the field adds). A null text has none.

    The field adds a segment where no fixed span lies: entities that a pattern has run into one.
    """
    if not text:
        return [], []
    base = base_spans(text)
    spans = list(base)
    if field.weights:
        for region in regions(text):
            first, last = region.start, region.groups[-1][1]
            inside = [s for s in base if s[1] < last and s[2] > first]
            if len(inside) == 1 and inside[0][2] - inside[0][1] >= last - first:
                continue
            shape = [g[1] - g[0] for g in region.groups] if not region.address else [0]
            for i, j, kind in field.best(region.address, shape, region.lattice()):
                a, b = region.bounds(i, j)
                if not any(a < y and x < b for _, x, y in inside) and _holds(kind, region.text[a:b]):
                    spans.append((kind, a, b))
    return base, sorted(set(spans), key=_place)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def scan(docs: DataFrame, field: Field, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, counts of the fixed patterns' spans, the digest of their list, and the list of all spans.

    Offsets are code points, ends exclusive. A null or empty text has no spans and the digest of an empty list.
    Repeated rows each get a row; other columns are left out.
    """
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)])
    for kind in KINDS:
        schema = schema.add(f"n_{kind}", "long")
    schema = schema.add("base_sha256", "string").add("spans", "string")
    shared = docs.sparkSession.sparkContext.broadcast(field.weights)

    def read(keys: list, texts: list) -> dict:
        held = Field(shared.value)
        found = [find(t, held) for t in texts]
        out = {key: keys, "spans": [listed(s) for _, s in found]}
        out["base_sha256"] = [hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found]
        for kind in KINDS:
            out[f"n_{kind}"] = [sum(k == kind for k, _, _ in b) for b, _ in found]
        return out

    rows = docs.select(key, F.col(text).alias("text" if key != "text" else "body"))
    return rows.mapInArrow(per_batch(read, rows.columns, schema), schema)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span, overlapping ones together, replaced by its first kind in angle brackets."""
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, start, end = spans[k]
        while k < len(spans) and spans[k][1] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The rows with personal data in ``text`` replaced; ``length``, if there is such a column, follows the new text."""
    shared = docs.sparkSession.sparkContext.broadcast(field.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Field(shared.value)
        for whole in batches:
            for batch in slices(whole, [text]):
                made = [redacted(t, find(t, held)[1]) for t in batch.column(text).to_pylist()]
                columns = {c: batch.column(c) for c in batch.schema.names}
                columns[text] = pa.array(made, type=batch.schema.field(text).type)
                yield pa.RecordBatch.from_pydict(columns)

    done = docs.mapInArrow(run, docs.schema)
    if length in docs.columns:
        done = done.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return done
