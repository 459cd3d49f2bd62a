import hashlib
import re

from brokerlens.llm import pii
from tests.llm.conftest import TEXTS


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
    out += [("ip", *m.span()) for m in ip if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        total = sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(d))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


CASES = [
    "a@b.c@d.e x@@y.z a@b@c.d é.x@mail-1.example.com. .@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3",
    "4539578763621486 4539-5787-6362-1486 4539578763621487", "+1 (974) 555-3436 +44.20.7946.0958 +1 2",
    "+1 (826) 555-4081 190.137.223.204 du", "4539578763621486 4845168114407329", "1" * 3000 + "." + "2" * 3000,
    "🙂 +49 30 1234567 🙂 me@x.org",
]


def test_fixed_patterns_equal_plain_ones():
    for text in CASES + [t for _, t, *_ in TEXTS if t and len(t) < 5000]:
        assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for unit in ("a", "1", "1.", "@", "a@", "+1", "1 ", "(", "a."):
        pii.find(unit * 60_000, pii.Field({"x": 1.0}))


def test_field_separates_what_patterns_run_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    field = pii.fit(docs)
    text = "Call +1 (826) 555-4081 190.137.223.204 or pay 4539578763621486 4539578763621486 now"
    base, spans = pii.find(text, field)
    assert [s[0] for s in base] == ["ip"]
    assert {(k, text[a:b]) for k, a, b in spans} == {
        ("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204"), ("card", "4539578763621486")
    }
    for clean in ("12345678 90123456 numbers 1234567890123456", "call 555 1234", "2024-01-31 10:20:30", "v1.2.3", None, ""):
        assert pii.find(clean, field) == ([], [])
    redacted = pii.redacted(text, spans)
    assert redacted == "Call <PHONE> <IP> or pay <CARD> <CARD> now"


def test_best_labelling_equals_enumeration():
    field = pii.Field({"none": 0.3, "card": -0.2, "card check True none": 1.1, "ip octets True": 2.0, "phone groups 3": 0.4,
                       "none > card": 0.2, "card > card": -0.4, "phone > none": 0.1})
    region = pii.Region("+1 4539578763621486 190.137.2.4", 0, 31, False)
    shape, lattice = [b - a for a, b in region.groups], region.lattice()
    ends = field.segments(False, shape, lattice)

    def every(at):
        if at == 0:
            yield [], 0.0, "start"
            return
        for i, kind, names in ends[at - 1]:
            for before, score, last in every(i):
                value = sum(field.weights.get(n, 0) for n in names) + field.weights.get(f"{last} > {kind}", 0)
                yield before + ([(i, at - 1, kind)] if kind != "none" else []), score + value, kind

    best = max(every(len(shape)), key=lambda x: x[1])
    found = field.best(False, shape, lattice)
    assert abs(dict((tuple(s), v) for s, v, _ in every(len(shape)))[tuple(found)] - best[1]) < 1e-9


def test_edge_rows_and_clashing_names(spark, corpus, crowded, nothing):
    field = pii.fit(corpus)
    rows = pii.scan(crowded, field).collect()
    assert len(rows) == len(TEXTS) and all(r["spans"] == "" for r in rows)
    assert {r["base_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert pii.redact(crowded, field).columns == crowded.columns
    assert pii.fit(nothing).weights == {} and pii.scan(nothing, field).count() == 0
