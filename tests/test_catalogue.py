import pytest
from pyspark.sql import functions as F

from tidemark.operators import pit
from tidemark.plans import catalogue, facts

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_sql(spark, agrees, name):
    agrees(catalogue.QUERIES[name](spark, DATA), catalogue.ORACLE_SQL[name])


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_both_scans(spark):
    plan = catalogue.QUERIES["q_base_revision_as_of"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LessThanOrEqual(o_orderdate") == 1 and "LessThanOrEqual(l_shipdate" in plan


def test_gaps_are_filled_for_all_users(spark):
    users = {r[0] for r in spark.read.parquet(f"{DATA}/events.parquet").select("user_id").distinct().collect()}
    assert {r.user_id for r in catalogue.QUERIES["q_fill_gaps"](spark, DATA).collect()} == users


def test_null_ranks_are_of_the_newest_versions(spark):
    """No fact's newest visible version is left out, and equal ranks without a checksum are settled by one order."""
    rows = pit.versions(facts.order_bases(spark, DATA), facts.line_revisions(spark, DATA), "fact_id", ["fact_id", "owner_id"], facts.moment(catalogue.KNOWN)).collect()
    newest = {}
    for r in rows:
        order = (r.available_at, r.version_rank, r.value_cents % 2 != 0, r.source_checksum)
        newest[r.fact_id] = max(newest.get(r.fact_id, (order, r.value_cents)), (order, r.value_cents))
    got = {r.fact_id: (r.available_at, r.version_rank, r.value_cents) for r in catalogue.QUERIES["q_null_rank_release"](spark, DATA).collect()}
    assert got == {k: (o[0], o[1], v) for k, (o, v) in newest.items()}


def test_equal_ranks_without_a_checksum_are_settled(spark):
    made = [(1, 5, 1, None, s) for s in ("a", "c", "b")] + [(1, 5, 0, "z", "z"), (1, 4, 1, None, "d")]
    rows = spark.createDataFrame(made, "fact_id int, available_at int, version_rank int, checksum string, source_checksum string")
    for again in (rows, rows.orderBy("source_checksum"), rows.orderBy(F.desc("source_checksum"))):
        assert pit.current_versions(again, "fact_id", checksum="checksum", nulls="first", tie="source_checksum").first().source_checksum == "c"


def test_titles_of_all_documents_are_matched(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert catalogue.QUERIES["q_title_normalise"](spark, DATA).count() == docs.count()


def test_marks_between_digits_agree_with_sql(spark, tmp_path):
    import duckdb

    texts = ["call 1(2)3 at 12:30:45/6", "a@b 1@2.5,6:7", "1.2:3,4/5", "+1 (415) 555-2671", "9:-3", "1::2", "", None, "x\n1:2"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, catalogue.QUERIES["q_title_normalise"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(catalogue.ORACLE_SQL["q_title_normalise"]).fetchall()) and got[1][1] == "a b 1|2.5.6|7"


def test_aliases_of_all_owners_are_resolved(spark):
    held = facts.validity(spark, DATA).collect()
    got = catalogue.QUERIES["q_alias_resolution"](spark, DATA).collect()
    assert {r.symbol for r in got} == {f"{r.alias}#{r.instrument_id // 10}" for r in held}
    assert {r.status for r in got} == {"ambiguous", "resolved", "inactive"}
