import pytest

from tarnlake.plans import api, named

SF = "/root/testdata/sf0.001"


def test_metric_calls(spark):
    whole = api.compute_metric(spark, SF, "m01_incident_count", "org", "quarter")
    assert {"W", "R0"} <= {r[0] for r in whole.select("entity_id").distinct().collect()}
    one = api.metric_series(spark, SF, "m01_incident_count", "3", window=("1996-01-01", "1997-01-01")).collect()
    assert [r["period_start"] for r in one] == sorted(r["period_start"] for r in one)
    assert api.compare_with_peers(spark, SF, "m08_repeat_rate").count() > 0
    for bad in (("nothing", "team"), ("m12_alert_noise_ratio", "team")):
        with pytest.raises(ValueError):
            api.compute_metric(spark, SF, *bad)


@pytest.mark.parametrize("name", sorted(named.REGISTRY))
def test_named_queries(spark, name):
    assert named.run(spark, SF, name, cap=3).count() <= 3


def test_named_rows(spark):
    assert [r["order_rank"] for r in named.run(spark, SF, "portfolio.rows", cap=3).collect()] == [1, 2, 3]
    best = named.run(spark, SF, "funding.ranking_by_priority", candidate_type="cluster_fix").head()
    assert named.run(spark, SF, "funding.attribution", candidate=best["candidate_id"]).count() > 0
    assert named.run(spark, SF, "clusters.members", cluster="c3").count() > 0


def test_named_parameters(spark):
    assert named.run(spark, SF, "incidents.by_state", since="2100-01-01").count() == 0
    with pytest.raises(ValueError):
        named.run(spark, SF, "org.list", nothing=1)
