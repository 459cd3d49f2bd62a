"""Quality rules: repetition within a document, and lines that many documents of a host share."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brokerlens.llm.common import free_name, per_batch, same, slices, text_key, written

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict.

    A line is boilerplate of a host if more than ``line_documents`` of the host's distinct documents hold it, or, in
    small hosts, more than ``line_least`` and more than ``line_share`` of them. A document is depleted if boilerplate
    has more than ``depleted`` of its words. Up to ``most_held`` boilerplate lines of all hosts are broadcast (a 64-bit
    hash each); if there are more, documents meet theirs by a shuffle instead, with the same result.
    """

    least_words: int = 50
    repeat_share: float = 0.5
    line_documents: int = 100
    line_least: int = 5
    line_share: float = 0.1
    depleted: float = 0.5
    most_held: int = 250_000


def line_key(line: bytes) -> int | None:
    """Signed 64-bit hash of a line, lower-cased (A-Z) with single spaces; None for a line without words."""
    words = line.lower().split()
    if not words:
        return None
    value = xxhash.xxh64_intdigest(b" ".join(words), 42)
    return value - (1 << 64) if value >> 63 else value


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, end = 0, 0
    for start, window in enumerate(windows):
        if times[window] > 1:
            covered += start + 3 - max(start, end)
            end = start + 3
    return covered


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, repeated words. A null text has none."""
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(text.count(b) for b in BLANKS)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(words), chars, sum(text.count(s) for s in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def _distinct_lines(hosts: list, texts: list, keys: list) -> dict:
    out: dict[str, list] = {"host": [], "line": [], "doc": []}
    for host, text, key in zip(hosts, texts, keys):
        found = {line_key(line) for line in (text or "").encode().split(b"\n")}
        found.add(None)  # the document itself, for the host's total
        out["host"] += [host] * len(found)
        out["line"] += list(found)
        out["doc"] += [key] * len(found)
    return out


def _lines(docs: DataFrame, text: str, host: str) -> DataFrame:
    """(host, line, doc): a row for each distinct line of each document, and one with a null line for itself."""
    schema = T.StructType().add("host", "string").add("line", "long").add("doc", "long")
    rows = docs.select(
        F.col(host).cast("string").alias("host"), F.col(text).alias("text"), text_key(F.col(text)).alias("doc")
    )
    return rows.mapInArrow(per_batch(_distinct_lines, ["host", "text", "doc"], schema), schema)


def _over(lines: DataFrame, rules: Rules) -> DataFrame:
    counts = lines.groupBy("host", "line").agg(F.countDistinct("doc").alias("n"))
    counts = written(counts.where(F.col("line").isNull() | (F.col("n") > min(rules.line_least, rules.line_documents))), "lines")
    total = counts.where("line IS NULL").select(F.col("host").alias("owner"), F.col("n").alias("total"))
    often = counts.where("line IS NOT NULL").join(total, same(F.col("host"), F.col("owner")))
    share = (F.col("n") > rules.line_least) & (F.col("n") > F.lit(rules.line_share) * F.col("total"))
    return often.where((F.col("n") > rules.line_documents) | share).select("host", "line", F.col("n").alias("documents"))


def common_lines(docs: DataFrame, rules: Rules = Rules(), text: str = "text", host: str = "source") -> DataFrame:
    """(host, line, documents): the hashes of each host's boilerplate lines and how many distinct documents hold them.

    Documents are counted once per distinct text, so copies of one document make none of its lines boilerplate.
    A null host is a host of its own; null and empty texts have no lines; an empty table has none. Each document
    sends a hash per distinct line; counts are taken in two steps with partial sums before each shuffle, so a line
    in every document does not gather anywhere.
    """
    return _over(_lines(docs, text, host), rules)


def _marked(docs: DataFrame, over: DataFrame, text: str, host: str) -> DataFrame:
    """(host, doc, lines): for each distinct document with boilerplate, the hashes of those of its own lines."""
    held = over.select(F.col("host").alias("owner"), F.col("line").alias("common"))
    own = _lines(docs, text, host).join(held, same(F.col("host"), F.col("owner")) & (F.col("line") == F.col("common")))
    return written(own.groupBy("host", "doc").agg(F.collect_set("line").alias("lines")), "marks")


def _verdicts(rules: Rules, text: str, lines: str, held: Broadcast | None, names: list[str], kept_only: bool):
    """Judges rows whose column ``lines`` is the host, to be looked up in ``held``, or without that their own lines."""
    schema = [pa.field(n, pa.int64()) for n in names[:6]] + [pa.field(n, pa.bool_()) for n in names[6:]]

    def of(value: str | None, bad: Iterable[int] | None) -> tuple:
        n, chars, symbols, dup, repeat = measures(value)
        failed = n < rules.least_words or repeat > rules.repeat_share * n
        gone, kept_text = 0, value
        if bad and n:
            drop, keep = bad if held else set(bad), []
            for line in value.split("\n"):
                raw = line.encode()
                if line_key(raw) in drop:
                    gone += len(raw.split())
                else:
                    keep.append(line)
            kept_text = "\n".join(keep) if gone else value
        kept = not failed and gone <= rules.depleted * n
        return (n, chars, symbols, dup, repeat, gone, failed, kept), kept_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, [text]):
                bad = batch.column(lines).to_pylist()
                if held:
                    bad = [held.value.get(owner) for owner in bad]
                made = [of(*pair) for pair in zip(batch.column(text).to_pylist(), bad)]
                columns = {name: batch.column(name) for name in batch.schema.names if name != lines}
                if kept_only:
                    columns[text] = pa.array([t for _, t in made], type=batch.schema.field(text).type)
                for k, field in enumerate(schema):
                    columns[field.name] = pa.array([row[k] for row, _ in made], type=field.type)
                out = pa.RecordBatch.from_pydict(columns)
                yield out.filter(columns[names[7]]) if kept_only else out

    return run


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_common_words", "base_failed", "kept"]


def _judged(docs: DataFrame, rules: Rules, text: str, host: str, kept_only: bool) -> tuple[DataFrame, list[str]]:
    names: list[str] = []
    for name in MEASURES:
        names.append(free_name([*docs.columns, *names], name))
    owner, mark, lines, own = (free_name(docs, name) for name in ("line_owner", "line_document", "line_hashes", "own_key"))
    over = written(common_lines(docs, rules, text, host), "over")
    held = None
    if over.count() <= rules.most_held:
        by_host: dict[str | None, set] = {}
        for row in over.collect():
            by_host.setdefault(row["host"], set()).add(row["line"])
        held = docs.sparkSession.sparkContext.broadcast(by_host)
        joined = docs.withColumn(lines, F.col(host).cast("string"))
    else:
        bad = _marked(docs, over, text, host).toDF(owner, mark, lines)
        met = same(F.col(host).cast("string"), F.col(owner)) & (F.col(own) == F.col(mark))
        joined = docs.withColumn(own, text_key(F.col(text))).join(bad, met, "left").drop(owner, mark, own)
    schema = T.StructType(list(docs.schema.fields))
    for k, name in enumerate(names):
        schema = schema.add(name, "long" if k < 6 else "boolean")
    return joined.mapInArrow(_verdicts(rules, text, lines, held, names, kept_only), schema), names


def judge(docs: DataFrame, rules: Rules = Rules(), text: str = "text", host: str = "source") -> DataFrame:
    """The documents with their measures and the verdict ``kept``.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_common_words, base_failed and kept (a name
    the table already has gets an underscore in front). Every row gets a row, repeated rows too. A null or empty
    text has no words and fails. An empty table gives an empty table.
    """
    return _judged(docs, rules, text, host, False)[0]


def clean(
    docs: DataFrame, rules: Rules = Rules(), text: str = "text", host: str = "source", length: str = "n_chars"
) -> DataFrame:
    """The documents that pass, boilerplate lines removed from their texts; the columns stay as they are.

    ``length``, if there is such a column, follows the new text. Null and empty texts have no words and go; repeated
    rows are judged alike and each of them stays or goes; an empty table gives an empty table.
    """
    kept = _judged(docs, rules, text, host, True)[0].select(*docs.columns)
    if length in docs.columns:
        kept = kept.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return kept
