import re
from itertools import permutations

import duckdb
import pyarrow as pa

from stoplake.llm import filter_audit
from stoplake.llm.registry import op13_filter_audit

DOCS, LABELS = "doc_id long, text string, source string, mask string, print string, part string", "doc_id long, quality int, toxic int, part string"
GOOD = " ".join(f"word{i}" for i in range(60))


def failures(rows):
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows)
        upper = sum("A" <= c <= "Z" for c in text)
        fails = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * upper > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), same)
        out.append("".join(f for f, x in zip("ABCDE", fails) if x))
    return out


def brute(rows, labels):
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    failed, out = failures(rows), []
    for part in sorted({s or "" for _, _, s in rows}):
        own = [(d, f) for (d, _, s), f in zip(rows, failed) if (s or "") == part]
        lost = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                earlier = set(order[: step - 1])
                removed = [d for d, x in own if f in x and not earlier & set(x)]
                lost[f] += len(removed)
                kept = sum(not set(order[:step]) & set(x) for _, x in own)
                redundant = sum(f in x and bool(earlier & set(x)) for _, x in own)
                steps.append((part, "".join(order), step, kept, len(removed), redundant, sum(x == f for _, x in own), sum(d in good for d in removed), sum(d in toxic for d in removed), f))
        out += [(*s[:-1], lost[s[-1]]) for s in steps]
    return sorted(out)


def tables(spark, rows, labels):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS), spark.createDataFrame([(*r, "x") for r in labels], LABELS)


def got(spark, rows, labels):
    return sorted(map(tuple, filter_audit.audit(*tables(spark, rows, labels)).collect()))


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, " \n\t", "a"), (3, " \n\t", "a"), (None, "", "a"), (None, GOOD, "b"), (5, GOOD, "b"), (4, GOOD, "c"), (6, GOOD + "\x0b#", "c")]
    rows += [(7, GOOD.upper(), "c"), (8, "é " * 70, "c"), (9, "x y " * 300_000, "d"), (10, "x y " * 300_000, "d"), (-1, "$", "d")]
    labels = [(1, 1, 0), (2, None, 1), (3, 1, 1), (3, 0, None), (None, 1, 1), (5, 1, 0), (5, 1, 1), (10, 1, 1), (77, 1, 1)]
    assert got(spark, rows, labels) == brute(rows, labels)


def test_groups_of_equal_texts_across_many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = [((i * 7919) % 400, GOOD if i % 3 else f"{GOOD} {i % 40}", f"s{i % 4}") for i in range(400)]
        df, labels = tables(spark, rows, [(i, i % 2, i % 5) for i in range(0, 400, 3)])
        assert df.repartition(9).select("doc_id").rdd.getNumPartitions() == 9
        found = {r.doc_id: r.mask for r in filter_audit.masks(df.repartition(9)).collect()}
        assert found == {d: sum(1 << "ABCDE".index(f) for f in x) for (d, *_), x in zip(rows, failures(rows))}
        assert sorted(map(tuple, filter_audit.audit(df, labels).collect())) == brute(rows, [(i, i % 2, i % 5) for i in range(0, 400, 3)])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_texts_that_share_a_fingerprint():
    """Two texts of one fingerprint, one of them over two batches; then the last fingerprint, again with two texts."""
    rows = [("p", 1, 7, "a"), ("p", 2, 7, "a"), ("p", 1, 7, "b"), ("p", 3, 7, "b"), ("p", 9, 7, "b"), ("p", 4, 8, "b"), ("p", 2, 9, "c"), ("p", 5, 9, "c"), ("p", 3, 9, "d")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("part", "doc_id", "print", "text"), r)) | {"mask": 0} for r in part]) for part in (rows[:4], [], rows[4:])if part]
    out = [r for b in filter_audit.compare(iter(batches)) for r in b.to_pylist()]
    seen, told = [r for r in out if r["part"]], [r for r in out if not r["part"]]
    assert [r["mask"] > 0 for r in seen] == [False, True, False, True, True, False, False, True, False]
    assert [r["border"] is not None for r in seen] == [True] * 5 + [False] * 4
    assert {(r["border"], r["doc_id"]) for r in told} == {(filter_audit._digest(t), d) for t, d in (("a", 1), ("b", 1), ("c", 2), ("d", 3))}


def test_counters_add_up(spark):
    """Counters of two halves, with duplicates decided over both, give the report of the whole."""
    rows = [(i, f"{GOOD} {i % 30}" if i % 2 else f"short {i % 9}", f"s{i % 3}") for i in range(90)]
    df, labels = tables(spark, rows, [(i, 1, i % 2) for i in range(0, 90, 2)])
    marked = filter_audit.masks(df)
    halves = [filter_audit.counters(marked.filter(f"doc_id % 2 = {k}"), labels) for k in (0, 1)]
    whole = filter_audit.report(filter_audit.counters(marked, labels)).collect()
    assert sorted(filter_audit.report(halves[0].union(halves[1])).collect()) == sorted(whole)


def test_empty_tables(spark):
    assert got(spark, [], []) == []
    assert got(spark, [(1, GOOD, "a")], []) == brute([(1, GOOD, "a")], [])


def test_query_matches_sql(spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rows = op13_filter_audit(spark, sf_dir)
    want = c.sql(filter_audit.ORACLE)
    assert rows.columns == want.columns and sorted(map(tuple, rows.collect())) == sorted(want.fetchall())
