"""The registered queries over the smallest tables: rows, columns, and SQL where there is any."""

import glob
import os

import duckdb
import pytest

from hirescope.llm import queries
from tools.check import rows

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op3_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op4_lm_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op5_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op6_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op9_jaccard_join": {"doc_id", "class_id", "n_links"},
    "op11_simhash": {"doc_id", "fingerprint", "component_id"},
    "op12_periodic_runs": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    "op10_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_per_document(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert set(got.columns) >= COLUMNS[name]
    ids = sorted(r["doc_id"] for r in got.select("doc_id").collect())
    want = sorted(r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert sorted(set(ids)) == sorted(set(want)) and (name.startswith("op2") or len(ids) == len(want))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cursor.fetchall())


def test_language_of_the_held_out(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) >= 0.97 * len(got) > 0


def test_links_of_all_documents(spark):
    """Every link of the table, through an inverted index of all grams."""
    from hirescope.llm import neardup

    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    sets = [set(neardup.grams((r["text"] or "").encode()).tolist()) for r in docs]
    want = {}
    for i, a in enumerate(sets):
        want[docs[i]["doc_id"]] = sum(
            len(a & b) >= neardup.SIMILARITY * len(a | b) for j, b in enumerate(sets) if j != i and a and b)
    got = {r["doc_id"]: r["n_links"] for r in queries.QUERIES["op9_jaccard_join"](spark, SF).collect()}
    assert got == want
