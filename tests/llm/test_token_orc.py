import re
import struct
import zlib

import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from stoplake.llm import token_orc
from stoplake.llm.registry import op4_token_orc

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string"


def expected(rows):
    t, start, out = Tokenizer.from_file(VOCABULARY), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_query_matches_the_library_on_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    assert sorted(map(tuple, op4_token_orc(spark, sf_dir).collect())) == sorted(expected(rows))


def test_awkward_rows(spark):
    odd = "a\x1c! \x1c b c d<|endoftext|> it's\r\n\tÉ ́x ' s 12\x0b3 İ... THE. É!! Ⅷ, ΣΑΣ."
    rows = [(5, None, "z"), (1, "", None), (3, odd, "x"), (3, odd, "x"), (2, "w" * 50_000, ""), (None, "No id", ""), (9, "\n \n", "")]
    got = token_orc.round_trip(spark.createDataFrame(rows, SCHEMA), VOCABULARY).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(expected([r[:2] for r in rows]), key=key)


def test_empty_table(spark):
    assert token_orc.round_trip(spark.createDataFrame([], SCHEMA), VOCABULARY).collect() == []


def test_lookup_skips_by_metadata(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text number ', id) AS text")
    token_orc.write_ids(docs, VOCABULARY, f"file://{tmp_path}/ids")
    found = token_orc.read_ids(spark, f"file://{tmp_path}/ids", [7, 2999])
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PushedFilters: \[[^\]]*In\(doc_id, \[(?:7,2999|2999,7)\]\)", plan)
    assert sorted(r.doc_id for r in found.collect()) == [7, 2999]


def rows_read(df):
    """Rows that the reader of a query gave, after it skipped stripes and row groups."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    scan = plan.collectLeaves().apply(0)
    return scan.metrics().apply("numOutputRows").value()


def test_row_groups_are_skipped_by_ranges_and_bloom_filters(spark, tmp_path):
    docs = spark.range(4000).selectExpr("2 * id AS doc_id", "concat('text number ', id) AS text").coalesce(1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        path = f"file://{tmp_path}/ids"
        token_orc.write_ids(docs, VOCABULARY, path)
        read = lambda doc_id: rows_read(spark.read.schema(token_orc.COLUMNS).orc(path).filter(f"doc_id = {doc_id}").select("n_tokens"))
        assert read(778) <= token_orc.INDEX_ROWS  # by the ranges of its file and row group
        assert sum(read(k) for k in (779, 2001, 5553, 7001)) <= token_orc.INDEX_ROWS  # within a range, but in no Bloom filter (1 in 100 may err)
        assert read(9999) == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rows_without_an_id_are_split(spark, tmp_path):
    docs = spark.range(3000).selectExpr("CAST(NULL AS long) AS doc_id", "concat('text number ', id) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_orc.write_ids(docs, VOCABULARY, f"file://{tmp_path}/ids")
        rows = token_orc.read_ids(spark, f"file://{tmp_path}/ids").orderBy("start").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({r.part for r in rows}) > 1 and len(rows) == 3000
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_table_of_pieces_is_pruned(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_orc, "TABLE_ENTRIES", 50)
    enc, t = token_orc.PieceEncoder(VOCABULARY, 2), Tokenizer.from_file(VOCABULARY)
    for k in range(40):
        texts = [f"the word{k} of {k}th, the w{k}x. " + "y" * k, None, ""]
        want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
        assert enc.encode(pa.array(texts, pa.string())).to_pylist() == want
    assert len(enc.known) < 120 and "the" in enc.known
