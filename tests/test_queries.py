import pytest

from oracle import same
from tessera.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    _, extra, missing = same(spark, registry.QUERIES[name], registry.SQL[name], FOLDER)
    assert not extra and not missing


@pytest.mark.parametrize("name", ["daily_clean_violations", "hist_proportions_check", "equal_lengths_check"])
def test_no_violations(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() == 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_a_query_writes_a_table_that_it_reads_often_once(spark):
    from tessera.plans import scope

    made = []
    real = scope.materialize
    scope.materialize = lambda df, name, checks=None: made.append(name) or real(df, name, checks)
    try:
        registry.QUERIES["forecast_pipeline"](spark, FOLDER)
    finally:
        scope.materialize = real
    assert sorted(made) == ["ensembles", "levels", "losses", "matrix"]


def test_fitted_path(spark):
    """The whole path over 2,499 days: shapes, keys without repeats, blends between models, no lag in place of a fit."""
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    out = entry.queries()["pipeline_end_to_end"](spark, folder).collect()
    assert len(out) == 42 * 60 == len({(r["ts_id"], r["time_d"]) for r in out})
    scores = {r["model"]: r["loss"] for r in entry.queries()["pipeline_scores"](spark, folder).collect()}
    models = [m for m in scores if m.startswith("mod_")]
    assert len(models) == 12 and all(v is not None for v in scores.values())
    assert scores["postValiMod_ens_ranked1"] <= min(scores[m] for m in models)
