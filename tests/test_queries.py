"""Queries of the catalogue against their SQL, at the smallest scale: those whose operators do more than a built-in function."""

import os
import uuid

import pytest

import __spark_entry__
from lodestone.operators import compare
from lodestone.plans import bundles, catalogue

SF = "/root/testdata/sf0.001"
SOME = ["top1_cohort_customers", "prj9_metadata_rules", "win5_pack_count", "agg8_pack_freshness", "joi1_receipt", "joi2_reuse_decision", "joi8_coverage", "flt16_admission", "win6_running_total", "str1_resume"]
SOME += ["prj1_all_tags", "prj2_all_tags", "prj2_tags_roundtrip", "prj8_tagged_rules", "agg1_tagged_rule_counts", "top1_tagged_cohort", "prj12_normalised", "prj13_pruned", "flt5_prefix_compaction", "flt15_log_group_pairs", "flt17_error_classes", "flt19_account_pin", "src7_settings", "src10_two_lists", "src11_lists_in_lists", "src12_subscriptions", "src14_sorted_tags"]
SOME += ["win4_greedy_pack", "win6_sequence", "grf1_cycle", "joi9_findings_grouped", "snk1_bounded_file", "snk2_part_descriptors", "snk3_packs_with_index", "src20_lockstep", "joi2_ledger_decision", "snk8_materialised", "snk6_archive_roundtrip", "str2_resumed_packs", "str4_state_problems"]


def rows_of(result):
    names = sorted(result.columns)
    return sorted((tuple(map(str, r)) for r in result.select(*names).collect()))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, duck, name):
    result = catalogue.QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in sorted(result.columns))
    want = duck.sql(f"SELECT {columns} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert rows_of(result) == sorted(tuple(map(str, r)) for r in want)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def test_the_entry_runs(spark):
    if os.path.isdir(SF):
        assert __spark_entry__.entry(spark).count() == 20


def noted(rows, folder):
    """``rows``, each batch of which leaves a file with its number of rows whenever it is worked out."""

    def run(batches):
        for batch in batches:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(batch.num_rows))
            yield batch

    return rows.mapInArrow(run, rows.schema)


def times(folder):
    return sum(int(p.read_text()) for p in folder.iterdir())


def test_the_ledger_query_reads_its_packs_once(spark, duck, tmp_path, monkeypatch):
    read = bundles.artifacts.read_packs
    monkeypatch.setattr(bundles.artifacts, "read_packs", lambda *a, **b: noted(read(*a, **b), tmp_path))
    bundles.joi2_ledger_decision(spark, SF).collect()
    assert times(tmp_path) == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0]


def test_entries_of_packs_are_worked_out_once(spark, tmp_path):
    rows = [(k % 3, f"k{k}", "e", k, "m") for k in range(90)]
    entries = spark.createDataFrame(rows, "pack long, key string, etag string, size long, metadata_digest string").repartition(2)
    found = compare.pack_freshness(noted(entries, tmp_path), ["pack"]).collect()
    assert {r["pack"]: (r["records"], r["bytes"]) for r in found} == {p: (30, sum(range(p, 90, 3))) for p in range(3)}
    assert times(tmp_path) == 90
