import base64
import gzip
import hashlib
import os

from brokerlens.llm import warc

PAGES = [(1, "u", "<p>a</p>"), (2, "v", "<p>b</p>"), (3, None, "<p>a</p>"), (4, "a\r\nb: c", None), (5, "w", ""), (5, "w", ""),
         (None, "n", "<p>b</p>"), (7, "é", "🙂" * 40_000), (8, "x", "\r\n\r\nWARC/1.1\r\n\r\n"), (1, "u", "<p>a</p>")]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_pages_come_back_with_revisits_to_the_smallest_id(spark):
    table = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    folder, manifest = warc.write(table, roll_bytes=300)
    rows = [tuple(r) for r in warc.read(folder, manifest, table.schema["page_id"]).collect()]
    want = [(k, len((h or "").encode()), digest(h)) for k, _, h in PAGES]
    assert sorted(map(str, (r[:3] for r in rows))) == sorted(map(str, want))
    by = {(r[0], r[3]): r[4] for r in rows}
    assert len([r for r in rows if r[3] == "response"]) == len({digest(h) for _, _, h in PAGES})
    assert by[1, "response"] is None and by[1, "revisit"] == 1 and by[3, "revisit"] == 1
    assert by[None, "revisit"] == 2 and by[4, "response"] is None and by[5, "revisit"] == 4


def test_files_are_listed_complete_and_standard(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    folder, manifest = warc.write(table, roll_bytes=40_000)
    path, listed = folder.removeprefix("file://"), {r["name"]: r for r in manifest.collect()}
    assert sorted(os.listdir(path)) == sorted(listed) and len(listed) > 5
    for name, row in listed.items():
        raw = open(f"{path}/{name}", "rb").read()
        held = list(warc.records(iter([raw])))
        assert row["bytes"] == len(raw) and row["records"] == len(held) - 1 and held[0][0]["WARC-Type"] == "warcinfo"
        assert gzip.decompress(raw).count(b"WARC/1.1\r\nWARC-Type: ") == len(held)
    again = warc.write(table, roll_bytes=40_000)[1]
    assert {r["name"]: r["crc32"] for r in again.collect()} == {n: r["crc32"] for n, r in listed.items()}


def test_a_least_size_for_revisits_and_an_empty_table(spark):
    table = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder, manifest = warc.write(table, least_revisit_bytes=9)
    rows = warc.read(folder, manifest, table.schema["page_id"]).collect()
    assert {r["record_type"] for r in rows} == {"response"} and len(rows) == len(PAGES)
    folder, manifest = warc.write(table.where("false"))
    assert warc.read(folder, manifest, table.schema["page_id"]).count() == 0
