"""Secrets in texts: fixed patterns, and strings whose sliding windows have a high Shannon entropy.

All of it is SQL expressions over a row; no Python runs on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns; a match shorter than asked for is dropped.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: A run either reaches the least length or gives no match, so the length is part of these two.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "entropy"]
SPANS = "array<struct<start:long,end:long>>"
#: Long arrays and candidates are worked off in chunks of this many; results do not depend on it.
CHUNK = 256
#: Weight of a fixed span in the sweep, above any number of spans of one text.
FIXED = 1 << 32

#: Alphabets of the character classes; the last holds all others. A candidate is a maximal stretch of one class.
CLASSES = {
    "hex": "0123456789abcdef",
    "upper_hex": "0123456789ABCDEF",
    "alphanumeric": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+-/0123456789=ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}

@dataclass(frozen=True)
class Limits:
    """Window length and least entropy in bits per character class, and what is never a secret.

    What a fixed span leaves of a stretch is listed from ``shortest`` characters on. ``allowed_patterns`` are searched in a candidate of a class; ``allowed`` are whole candidates.
    """

    window: int = 20
    shortest: int = 16
    bits: tuple[tuple[str, float], ...] = (("hex", 3.0), ("upper_hex", 3.0), ("alphanumeric", 3.8), ("base64", 3.9))
    allowed_patterns: tuple[str, ...] = (
        r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
        r"(?i)example|sample|placeholder|dummy|changeme",
        r"(?i)0123456789|abcdefghij|qwertyuiop",
        r"^[^0-9]*$",
        r"^[^A-Za-z]*$",
    )
    allowed: tuple[str, ...] = ()


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums(values: Column) -> Column:
    """Running sums of longs. They are taken chunk by chunk, so a long array costs no more for each value than a short one."""
    none = F.array().cast("array<long>")
    last = lambda held: F.coalesce(F.get(held, F.size(held) - 1), F.lit(0).cast("long"))

    def running(chunk: Column) -> Column:
        return F.aggregate(chunk, none, lambda held, x: F.array_append(held, last(held) + x))

    def joined(chunks: Column) -> Column:
        before = F.aggregate(chunks, F.array(F.lit(0).cast("long")), lambda held, c: F.array_append(held, last(held) + last(c)))
        return F.flatten(F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), lambda c, b: F.transform(c, lambda x: x + b)))

    def chunked(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(CHUNK))
        return _let(F.transform(starts, lambda at: running(F.slice(v, at, F.lit(CHUNK)))), joined)

    return _let(values, chunked)


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """[(start, end, text, group)] of all leftmost matches that do not overlap, in code points.

    The pattern also cuts the text, so a match begins where the matches and the gaps before it end.
    """
    none = F.array().cast("array<struct<start:long,end:long,hit:string,part:string>>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def placed(gaps: Column, found: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: (F.length(g) + F.length(h)).cast("long"))
        return F.transform(
            F.arrays_zip(_sums(lengths).alias("end"), found.alias("hit"), parts.alias("part")),
            lambda x: F.struct((x["end"] - F.length(x["hit"])).alias("start"), x["end"], x["hit"], x["part"]),
        )

    return F.when(text.rlike(pattern), _let(hits, lambda h: placed(F.split(text, pattern, -1), h))).otherwise(none)


def _weight(count: int) -> float:
    return count * math.log2(count) if count > 1 else 0.0


def _high_runs(piece: Column, alphabet: str, window: int, least: float) -> Column:
    """[(start, end)] in a piece of a candidate: each run of consecutive windows with ``least`` bits of entropy or more.

    Counts per character move with the window: one goes up, one goes down, and with them the sum of c * log2(c), from
    which the entropy of w characters follows as log2(w) - sum / w.
    """
    weights = F.array(*(F.lit(_weight(c)) for c in range(window + 2)))
    codes = F.transform(F.split(piece, ""), lambda c: F.position(c, F.lit(alphabet)))
    # What enters and what leaves, side by side; 0 while nothing leaves yet.
    moves = F.arrays_zip(codes.alias("new"), F.concat(F.array_repeat(F.lit(0), window), codes).alias("old"))
    nothing = F.lit(None).cast("int")

    def closed(held: Column) -> Column:
        run = F.struct(held["first"].cast("long").alias("start"), held["at"].cast("long").alias("end"))
        return F.when(held["first"].isNull(), held["runs"]).otherwise(F.array_append(held["runs"], run))

    def step(held: Column, x: Column) -> Column:
        full, after = x["old"] > 0, held["at"] + 1
        n = F.get(held["counts"], x["new"])
        up = held["sum"] + F.get(weights, n + 1) - F.get(weights, n)
        m = F.get(held["counts"], x["old"]) + F.when(x["old"] == x["new"], 1).otherwise(0)
        total = F.when(full, up + F.get(weights, m - 1) - F.get(weights, m)).otherwise(up)
        counts = F.transform(
            held["counts"],
            lambda c, k: c + F.when(k == x["new"], 1).otherwise(0) - F.when(full & (k == x["old"]), 1).otherwise(0),
        )
        high = (after >= window) & (F.lit(math.log2(window)) - total / window >= least - 1e-9)
        return F.when(
            x["new"].isNotNull(),
            F.struct(
                after.alias("at"), counts.alias("counts"), total.alias("sum"),
                F.when(high, F.coalesce(held["first"], after - window)).otherwise(nothing).alias("first"),
                F.when(high, held["runs"]).otherwise(closed(held)).alias("runs"),
            ),
        ).otherwise(held)  # the last leaving ones have nothing beside them

    start = F.struct(
        F.lit(0).alias("at"), F.array_repeat(F.lit(0), len(alphabet) + 1).alias("counts"), F.lit(0.0).alias("sum"),
        nothing.alias("first"), F.array().cast(SPANS).alias("runs"),
    )
    return F.aggregate(moves, start, step, closed)


def _candidates(text: Column, name: str, limits: Limits) -> Column:
    """[(start, end, hit, part)] of the maximal stretches of a class that have a window and are not allowed."""
    letters = "[" + CLASSES[name].replace("-", r"\-") + "]"
    found = _found(text, f"(?<!{letters}){letters}{{{limits.window},}}")
    return F.filter(found, lambda s: ~_allowed(s["hit"], limits))


def _high(candidate: Column, name: str, least: float, window: int) -> Column:
    """[(start, end)] within the text of a candidate's runs of high windows.

    A candidate is looked at in pieces that overlap by a window less one, so each window lies in one piece.
    """
    pieces = F.regexp_extract_all(candidate["hit"], F.lit(f"(?=(.{{{window},{CHUNK + window - 1}}})).{{1,{CHUNK}}}"), F.lit(1))

    def of(piece: Column, at: Column) -> Column:
        before = candidate["start"] + at * CHUNK
        return F.transform(
            _high_runs(piece, CLASSES[name], window, least),
            lambda r: F.struct((before + r["start"]).alias("start"), (before + r["end"]).alias("end")),
        )

    return F.flatten(F.transform(pieces, of))


def _outside(spans: Column, fixed: Column, shortest: int) -> Column:
    """[(start, end)] of the maximal stretches in a span and in no fixed one, of ``shortest`` characters or more.

    One sweep over where spans begin and end: the running sum counts the spans that are open in its lower half and the
    fixed ones in its upper half.
    """

    def ends(of: Column, weight: int) -> Column:
        step = lambda at, n: F.struct(at.alias("at"), F.lit(n).cast("long").alias("step"))
        return F.flatten(F.transform(of, lambda s: F.array(step(s["start"], weight), step(s["end"], -weight))))

    def beside(v: Column) -> Column:
        """Each element with the one before and the one after it."""
        empty = F.slice(v, F.lit(1), F.lit(0))
        front = F.concat(F.transform(F.slice(v, F.lit(1), F.least(F.size(v), F.lit(1))), lambda _: F.lit(None)), v)
        return F.arrays_zip(v.alias("own"), front.alias("before"), F.coalesce(F.slice(v, F.lit(2), F.size(v)), empty).alias("after"))

    def swept(events: Column) -> Column:
        open_ = F.zip_with(
            events, _sums(F.transform(events, lambda e: e["step"])),
            lambda e, n: F.struct(e["at"].alias("at"), n.between(1, FIXED - 1).alias("on")),
        )
        # What holds behind a place is what its last event says.
        last = F.transform(
            F.filter(_let(open_, beside), lambda x: x["own"].isNotNull() & ~F.coalesce(x["own"]["at"] == x["after"]["at"], F.lit(False))),
            lambda x: x["own"],
        )
        return F.transform(
            F.filter(_let(last, beside), lambda x: x["own"].isNotNull() & (x["own"]["on"] != F.coalesce(x["before"]["on"], F.lit(False)))),
            lambda x: x["own"],
        )

    def paired(turns: Column) -> Column:
        on, off = F.filter(turns, lambda t: t["on"]), F.filter(turns, lambda t: ~t["on"])
        both = F.zip_with(on, off, lambda a, b: F.struct(a["at"].alias("start"), b["at"].alias("end")))
        return F.filter(both, lambda s: s["end"] - s["start"] >= shortest)

    events = F.array_sort(F.concat(ends(spans, 1), ends(fixed, FIXED)))
    return _let(_let(events, swept), paired)


def _allowed(hit: Column, limits: Limits) -> Column:
    out = hit.isin(*limits.allowed) if limits.allowed else F.lit(False)
    for pattern in limits.allowed_patterns:
        out = out | hit.rlike(pattern)
    return out


def scan(docs: DataFrame, limits: Limits = Limits(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_assign, n_access, n_hex, base_sha256 and spans ("kind:start:end", comma-joined).

    Offsets are code points, ends exclusive; spans are in order of start, then kind as in ``KINDS``. An entropy span is
    a maximal stretch of characters that lie in a window of high entropy and in no fixed span. Candidates are the
    maximal stretches of each class, so a key glued to a name or a path is judged by its own class too, and an allowed
    word beside it does not suppress it. Work grows in step with a text's length, whatever it matches. A null or
    empty text has none and the digest of an empty list. Repeated rows each get a row; other columns are left out.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("k"),
        F.filter(_found(body, ASSIGN, 2), lambda s: F.length(s["part"]) >= ASSIGN_LEAST).alias("assign"),
        _found(body, ACCESS).alias("access"),
        _found(body, HEX).alias("hex"),
        *(_candidates(body, name, limits).alias(f"in_{name}") for name, _ in limits.bits),
    )

    def placed(name: str) -> Column:
        kind = F.lit(KINDS.index(name))
        return F.transform(F.col(name), lambda s: F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end")))

    rows = rows.withColumn("base", F.array_sort(F.concat(placed("assign"), placed("access"), placed("hex"))))

    def stretches(name: str, least: float) -> Column:
        held = F.flatten(F.transform(f"in_{name}", lambda c: _high(c, name, least, limits.window)))
        return F.when(F.size(f"in_{name}") > 0, held).otherwise(F.array().cast(SPANS))

    rows = rows.withColumn("entropy", F.concat(*(stretches(name, least) for name, least in limits.bits)))
    cut = _outside(F.col("entropy"), F.col("base"), limits.shortest)
    rows = rows.withColumn("entropy", F.when(F.size("entropy") > 0, cut).otherwise(F.col("entropy")))
    names = F.array(*(F.lit(k) for k in KINDS))

    def listed(spans: Column) -> Column:
        shown = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(shown, ",")

    return rows.select(
        F.col("k").alias(key),
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat(F.col("base"), placed("entropy")))).alias("spans"),
    )
