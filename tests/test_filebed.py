"""Batches of some entities: what a query's tables need, and no more."""

import pytest

from lakeward.operators import silver
from lakeward.plans import filebed, filequeries, pipeline
from lakeward.sources import files

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def fresh(monkeypatch):
    monkeypatch.setattr(filebed, "_made", {})


def test_a_query_of_patients_delivers_and_loads_patients_alone(spark, fresh):
    assert filequeries.snk_silver_patients(spark, DATA).count() > 0
    config = filebed.warehouse(spark, DATA, ("patients",))
    assert {n.split("_")[0] for n in files.names(spark, f"{config.data_root}/batch_1", folders=False) if not n.startswith(".")} == {"patients"}
    assert files.names(spark, config.path("bronze"), folders=True) == ["patients"]
    runs = [(r["batch_id"], r["status"]) for r in pipeline.load_audit(spark, config).orderBy("started_at").collect()]
    assert runs == [(b, "SUCCESS") for b in filebed.RUNS] + [("batch_7", "FAILED")]
    assert not files.exists(spark, config.path("gold"))
    assert filebed.warehouse(spark, DATA, ("patients",)) is config


def test_landing_is_seen_without_loading(spark, fresh):
    assert all(r["same_bytes"] and r["same_times"] for r in filequeries.src_landing_copy(spark, DATA).collect())
    config = filebed.ingested(spark, DATA, bronze=False)
    assert files.names(spark, config.warehouse, folders=True) == ["landing"]


def test_parents_come_along(spark, fresh):
    assert silver.with_parents("claims") == ("patients", "encounters", "claims")
    config = filebed.delivery(spark, DATA, ("patients",))
    with pytest.raises(ValueError, match="encounters"):
        pipeline.run_batch(spark, config, "batch_0", ("encounters",))
