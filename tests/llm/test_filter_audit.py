"""The audit held against its SQL, and against orders applied one by one in Python."""

import re
from itertools import permutations

import duckdb
import pytest

from pathloom.llm import filter_audit

ROWS = [
    (1, "word " * 250, "en"), (2, "word " * 250, "en"), (3, "word " * 250, "de"), (4, None, "en"), (5, "", None), (6, "", "en"), (7, "SHOUT # it", "en"),
    (8, " ".join(f"w{k}" for k in range(300)), "de"), (8, " ".join(f"w{k}" for k in range(300)), "de"), (9, " ".join(f"w{k}" for k in range(300)), "fr"), (None, "SHOUT # it", "en"),
    (0, "SHOUT # it", "en"), (10, " \t\n\x0b ", None), (11, "é" * 40 + " A\x1cB nbsp　wide", ""), (12, "x" * 100_000 + " & y", "en"), (8, "other text of the same id", "de"), (13, "word " * 250, "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (8, 1, None), (8, 0, 1), (9, None, None), (None, 1, 1), (7, 0, 1), (13, 1, 0)]


def frames(spark, rows, labels=LABELS):
    """Columns whose names clash with those used inside."""
    docs = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], "doc_id long, text string, lang string, part int, own string, copies int")
    return docs, spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, labelled int")


def sequentially(rows, labels):
    """Every order applied from left to right to the rows of each part."""
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    held = {}
    for i, text, lang in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > least.get(text, i),
        }
        held.setdefault(lang or "", []).append((i, {k for k, v in fails.items() if v}))
    out = set()
    for part, docs in held.items():
        shares, steps = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            kept = docs
            for step, name in enumerate(order, 1):
                gone = [d for d in kept if name in d[1]]
                again = sum(name in d[1] for d in docs) - len(gone)
                kept = [d for d in kept if name not in d[1]]
                shares[name] += len(gone)
                steps.append((order, step, len(kept), len(gone), again, sum(d[1] == {name} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
        out |= {(part, *s, shares[s[0][s[1] - 1]]) for s in steps}
    return out


def test_audit_equals_orders_applied_one_by_one(spark):
    got = [tuple(r) for r in filter_audit.audit(*frames(spark, ROWS)).collect()]
    want = sequentially(ROWS, LABELS)
    assert len(got) == len(want) == 600 * 4 and set(got) == want


def test_audit_without_rows_and_without_labels(spark):
    assert filter_audit.audit(*frames(spark, [])).count() == 0
    got = {tuple(r) for r in filter_audit.audit(*frames(spark, ROWS, [])).collect()}
    assert got == sequentially(ROWS, [])


def test_a_hot_text_is_counted_by_text(spark):
    rows = [(k, "the same text", "en" if k % 2 else "de") for k in range(3000)]
    got = {tuple(r) for r in filter_audit.audit(*frames(spark, rows)).collect()}
    first = {(r[0], r[1]): r for r in got if r[2] == 1}
    assert first["de", "EABCD"][4] == 1499 and first["en", "EABCD"][4] == 1500 and first["de", "ABCDE"][3:5] == (0, 1500)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_audit_equals_its_sql(spark, folder):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    result = con.execute(filter_audit.SQL)
    names, types = [d[0] for d in result.description], [str(d[1]) for d in result.description]
    frame = filter_audit.audit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).select(*names)
    assert [t for _, t in frame.dtypes] == [{"VARCHAR": "string", "INTEGER": "int", "BIGINT": "bigint"}[t] for t in types]
    assert sorted(tuple(r) for r in frame.collect()) == sorted(result.fetchall())
