import pytest

from quillspan.llm import mixing


def test_targets_are_met_with_production_parameters(spark):
    sf = "/root/testdata/sf0.1"
    out = mixing.rates(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    total = out.n_tokens.sum()
    assert len(out) == 10_000 and (out.rate >= 0).all()
    for name, share in mixing.TARGETS.items():
        assert (out.rate * out.n_tokens * out[f"p_{name}"]).sum() / total == pytest.approx(share, rel=1e-3)


def posteriors(spark, rows):
    return spark.createDataFrame([(n, p, 1 - p) for n, p in rows], "__mix_n int, __mix_p0 double, __mix_p1 double")


def test_rates_are_the_nearest_to_one(spark):
    """A target that empties the rows of small posteriors: 10 r + 10 s = 20 and 9 r + 2 s = 18, of which s = 0 and r = 2."""
    stats = posteriors(spark, [(10, 0.9), (10, 0.2)])
    got = [r["__mix_r"] for r in mixing.solve(stats, [0.9, 0.1]).column(stats).orderBy("__mix_p0").collect()]
    assert got == pytest.approx([0, 2], abs=1e-3)


def test_unmet_targets_are_told(spark, caplog):
    stats = posteriors(spark, [(10, 0.6), (10, 0.4)])
    with caplog.at_level("WARNING"):
        found = mixing.solve(stats, [0.99, 0.01])
    assert max(map(abs, found.error)) > 0.1 and "less targets" in caplog.text
    assert mixing.solve(posteriors(spark, [(10, 0.5), (10, 0.5)]), [0.5, 0.5]).u == [0.0, 0.0]
