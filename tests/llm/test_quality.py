import re
from collections import Counter, defaultdict

import duckdb

from brokerlens.llm import oracles, quality
from tests.llm.conftest import TEXTS


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def plain_cleaned(rows, rules=quality.Rules()):
    """doc_id -> cleaned text of what is kept, of rows (doc_id, text, host)."""

    def norm(line):
        return " ".join(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))

    holders, total, out = defaultdict(set), defaultdict(set), {}
    for _, text, host in rows:
        total[host].add(text)
        for line in (text or "").split("\n"):
            holders[host, norm(line)].add(text)
    for key, text, host in rows:
        n, _, _, _, repeat = plain(text)
        keep, gone = [], 0
        for line in (text or "").split("\n"):
            held = len(holders[host, norm(line)])
            share = held > rules.line_least and held > rules.line_share * len(total[host])
            if norm(line) and (held > rules.line_documents or share):
                gone += len(norm(line).split(" "))
            else:
                keep.append(line)
        if n >= rules.least_words and repeat <= rules.repeat_share * n and gone <= rules.depleted * n:
            out[key] = "\n".join(keep)
    return out


def test_measures_equal_plain_ones():
    more = ["a b c a b c a", "#x $y | z\n\n#x $y | z\n", "a a a a", "\x85a\xa0b \x1c c", "p q r s p q r t q r s"]
    for text in [t for _, t, *_ in TEXTS] + more:
        assert quality.measures(text) == plain(text)


def test_edge_rows_and_clashing_names(spark, corpus, crowded, nothing):
    rows = quality.judge(corpus).collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        n = plain(row["text"])
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == n
        assert row["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
    again = quality.judge(crowded)
    assert "_kept" in again.columns and again.where("_kept = true").count() == sum(r["kept"] for r in rows)
    assert quality.judge(nothing).count() == 0
    assert quality.clean(crowded).columns == crowded.columns and quality.clean(nothing).count() == 0


def test_common_lines_of_a_host_go(spark):
    rules = quality.Rules(least_words=1, repeat_share=2.0, line_documents=3, line_share=0.2)
    body = [f"own text {i} of document number {i} with words enough" for i in range(10)]
    rows = [(i, f"Shared  BANNER here\n{t}", "a") for i, t in enumerate(body)]
    rows += [(100 + i, f"Shared banner here\n{t}", "b") for i, t in enumerate(body[:3])]  # 3 are not over the limit
    rows += [(200, "shared banner here\nshared banner here\nx", "a"), (201, "shared banner here", None)]
    rows += [(300 + i, "copy of one text\nits second line", "a") for i in range(50)]  # copies count once
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = {r["doc_id"]: r for r in quality.judge(docs, rules).collect()}
    assert all(judged[i]["n_common_words"] == 3 and judged[i]["kept"] for i in range(10))
    assert all(judged[100 + i]["n_common_words"] == 0 for i in range(3))
    assert judged[200]["n_common_words"] == 6 and not judged[200]["kept"]
    assert judged[201]["n_common_words"] == 0 and judged[300]["kept"]
    cleaned = {r["doc_id"]: r["text"] for r in quality.clean(docs, rules).collect()}
    assert cleaned[4] == body[4] and 200 not in cleaned and cleaned[100] == rows[10][1]


def test_lines_go_by_count_in_large_hosts_and_by_share_in_small_ones(spark, tmp_path):
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, f"Shared  by 5 percent\n{words(i)}" if i % 20 == 0 else words(i), "large") for i in range(2200)]
    rows += [(3000 + i, "in every\tfooter here\n" * 2 + words(i), "small") for i in range(6)]
    rows += [(3100 + i, f"shared by 5 percent\n{words(i)}", "small") for i in range(5)]  # five are not over the limit
    rows += [(3200 + i, "of no host\n" + words(i), None) for i in range(7)]
    rows += [(3300 + i, "in every footer here " * 9 + "\n" + words(i), "mostly") for i in range(6)]
    rows += [(3400 + i, "\n".join(["in every footer here " * 20, words(i)]), "depleted") for i in range(6)]
    rows += [(3500 + i, "one text\n" + words(1), "copies") for i in range(300)] + [(3900, None, "small"), (3901, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cleaned = {r["doc_id"]: r["text"] for r in quality.clean(docs).collect()}
    assert cleaned == plain_cleaned(rows)
    shuffled = quality.clean(docs, quality.Rules(most_held=0)).collect()
    assert {r["doc_id"]: r["text"] for r in shuffled} == cleaned and len(shuffled) == len(cleaned)
    assert cleaned[0] == words(0) and cleaned[3000] == words(0) and cleaned[3200] == words(0)
    assert cleaned[3100].startswith("shared") and cleaned[3500].startswith("one") and not {3400, 3405, 3900, 3901} & set(cleaned)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        wanted = {(r[0], r[6], r[8]) for r in db.execute(oracles.QUALITY).fetchall()}
    assert {(r["doc_id"], r["n_common_words"], r["kept"]) for r in quality.judge(docs).collect()} == wanted
