from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.plans import lakehouse
from tidemark.plans.catalog import mean_shift, scenario
from tidemark.sources import simulator


def test_layers_from_bronze_to_serving(spark):
    instrument = scenario(faults=(mean_shift(8.0),), per_hour=12)
    lakehouse.reset(spark, "default")
    lakehouse.land(simulator.simulate(spark, instrument), "default", simulator.ground_truth(spark, instrument))
    lead = F.col("day") < F.lit((datetime(2024, 6, 10) + timedelta(days=14)).date())
    lakehouse.build(spark, "default", lead, bins=48)
    assert lakehouse.consistent(spark, "default")
    found = {str(r["day"]) for r in spark.table("default.drift").where("is_drift").collect()}
    assert found >= {"2024-06-27", "2024-06-28", "2024-06-29"}
    assert spark.table("default.fingerprints").count() == 28 * 24
    assert spark.table("default.histogram").agg(F.sum("cnt")).first()[0] == 28 * 24 * 12
    plan = spark.table("default.increment_fact").where("event_date = DATE '2024-06-12'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    lakehouse.reset(spark, "default")
    assert not {t.name for t in spark.catalog.listTables() if not t.isTemporary} & set(lakehouse.TABLES)
