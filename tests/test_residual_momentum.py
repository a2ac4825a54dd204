"""mk26 returns values of ordinary size, not only multiples of 100."""
from panelquant.queries import REGISTRY, load_all


def test_ordinary_values_are_kept(spark):
    load_all()
    got = [r["ResidMom"] for r in REGISTRY["mk26_residual_momentum"](spark, "/root/testdata/sf0.001").where("ResidMom is not null").collect()]
    assert any(0 < abs(x) < 100 for x in got), got[:20]
