"""The event-level comparison fits the published forest."""

import pytest

from checks import registry
from checks.base import QUERIES
from gapline.plans import training as tr


def test_event_comparison_fits_the_published_forest(spark, sf, monkeypatch):
    registry.load()
    seen = {}

    def taken(events, device, learners, *args, **options):
        seen.update(learners)
        raise StopIteration

    monkeypatch.setattr(tr, "compare_on_events", taken)
    with pytest.raises(StopIteration):
        QUERIES["m10_event_comparison"](spark, sf)
    forest = seen["forest"](None)
    assert (forest.trees, forest.depth, forest.min_leaf, forest.tries(21)) == (200, 30, 2, 21)
