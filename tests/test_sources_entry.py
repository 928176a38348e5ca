import pytest

from tests.helpers import SF_SMALL
from outletlens.sources.fixture import outlet_month
from outletlens.sources.io import OutletDataError, read_outlets, write_csv


def test_csv_round_trip_and_errors(spark, tmp_path):
    om = outlet_month(spark, SF_SMALL)
    p = str(tmp_path / "outlets_csv")
    write_csv(om, p)
    back = read_outlets(spark, [str(tmp_path / "nope.csv"), p], fmt="csv")
    assert back.count() == om.count()
    assert dict(back.dtypes)["MonthlyOrders"] == "int"
    with pytest.raises(OutletDataError):
        read_outlets(spark, str(tmp_path / "absent.csv"))
    bad = str(tmp_path / "bad_csv")
    write_csv(om.drop("AOV"), bad)
    with pytest.raises(OutletDataError):
        read_outlets(spark, bad, fmt="csv")


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 15
    assert "OptScore" in df.columns
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(o) >= 60


def test_fixture_row_counts(spark):
    assert outlet_month(spark, SF_SMALL).count() == 826


def test_scenario_exports_round_trip(spark, tmp_path):
    from outletlens.operators import scenarios as S
    from outletlens.sources.io import write_exports
    from outletlens.plans.catalog import base_table, code_tables
    from outletlens.sources.fixture import scenarios_from_outlets
    bt = base_table(spark, SF_SMALL)
    scen = scenarios_from_outlets(bt)
    breakdown = S.channel_breakdown(scen)
    sweep = S.unit_economics_profit(S.feature_columns(S.commission_sweep(
        S.attach_codes(scen, codes=code_tables(spark, SF_SMALL)))))
    summary = scen.select("scenario_id", "name", "commission")
    paths = write_exports(str(tmp_path / "exports"), summary, breakdown,
                          sweep.select("scenario_id", "sweep_idx", "commission", "ue_profit"))
    back = spark.read.option("header", True).csv(paths["scenario_breakdown"])
    assert back.count() == breakdown.count() == 4 * scen.count()
    assert spark.read.option("header", True).csv(paths["scenario_sensitivity_sweep"]).count() == 30 * scen.count()
