"""The ridge query predicts every device, not a handful of figures of the fit."""

from checks import registry
from checks.base import QUERIES, dev


def test_every_device_is_predicted(spark, sf):
    registry.load()
    rows = QUERIES["m2_ridge"](spark, sf)
    assert rows.count() == dev(spark, sf).count() > 100
    assert rows.filter("predicted is null or not stationary").isEmpty()
    assert {r[0] for r in rows.select("is_test").distinct().collect()} == {True, False}
