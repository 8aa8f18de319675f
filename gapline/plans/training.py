"""Training jobs: device-level regression with stratified split, and its event-level control."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.functions.bins import MTBF_DAY_EDGES, hash_bucket, right_closed_bin
from gapline.operators.encode import Categories, encode, fit as fit_categories
from gapline.operators.models import (Comparison, Learner, fit, level_comparison, predict,
                                      top_features, train_and_compare)
from gapline.operators.quantiles import column_quantiles
from gapline.operators.scale import cut_lineage
from gapline.operators.split import group_split, take_side, with_side
from gapline.plans.events import TARGET as EVENT_TARGET, V3_HISTORY, Columns

# Features of the device table in order, and the bucket counts of its categories.
DEVICE_FEATURES = ("n_failures", "std_mtbf_h", "min_mtbf_h", "max_mtbf_h", "avg_repair_h",
                   "max_repair_h", "aging_days", "fail_rate_monthly")
CATEGORY_BUCKETS = {"station": 500, "brand": 100, "line": 100}
TARGET = "avg_mtbf_h"


def with_stratum(devices: DataFrame, edges: Sequence[float] = MTBF_DAY_EDGES,
                 target: str = TARGET) -> DataFrame:
    """Bin of the mean gap in days; it balances the split."""
    return devices.withColumn("stratum", right_closed_bin(F.col(target) / 24, edges))


def encode_devices(devices: DataFrame, categories: Sequence[str] = ("station", "brand", "line"),
                   hashed: bool = False, fitted: Categories | None = None) -> DataFrame:
    """Add <category>_enc: label codes of `fitted` (of these devices by default) or hash buckets.

    Categories the fit has not seen get -1.
    """
    if hashed:
        return devices.withColumns({
            f"{c}_enc": hash_bucket(F.col(c), CATEGORY_BUCKETS.get(c, 100)) for c in categories})
    if fitted is None:
        fitted = fit_categories(devices, categories)
    names = {c: f"{c}_enc" for c in categories}
    return encode(devices, fitted, codes=names).fillna(-1, list(names.values()))


@dataclass
class Sides:
    train: DataFrame
    test: DataFrame
    features: list[str]


def device_sides(devices: DataFrame, device: str,
                 categories: Sequence[str] = ("station", "brand", "line"),
                 edges: Sequence[float] = MTBF_DAY_EDGES, hashed: bool = False,
                 seed: int = 42) -> Sides:
    """Stratified split by device; category codes are learned from the training devices."""
    # Fitting reads its table many times, so the windows behind it are computed once.
    binned = cut_lineage(with_stratum(devices, edges))
    split = cut_lineage(group_split(binned, device, seed=seed, stratum="stratum"))
    train = take_side(binned, split, device, test=False)
    test = take_side(binned, split, device, test=True)
    features = [*DEVICE_FEATURES, *[f"{c}_enc" for c in categories]]
    fitted = None if hashed else fit_categories(train, categories)
    return Sides(cut_lineage(encode_devices(train, categories, hashed, fitted)),
                 cut_lineage(encode_devices(test, categories, hashed, fitted)), features)


def _validation(train: DataFrame, device: str, share: float, seed: int) -> tuple[DataFrame, DataFrame | None]:
    """Fit and validation rows: a share of the training devices is held back for the weights."""
    if not share:
        return train, None
    split = cut_lineage(group_split(train, device, share, seed + 1))
    return take_side(train, split, device, test=False), take_side(train, split, device, test=True)


def compare_on_devices(devices: DataFrame, device: str, learners: Mapping[str, Learner],
                       ensemble: Sequence[str] = (), *, stacks: Mapping[str, Sequence[str]] | None = None,
                       validation_share: float = 0.0, **split) -> Comparison:
    """Models and ensembles on device rows. With a validation share the ensemble weights come from
    training devices that the models do not see; else from the training rows."""
    sides = device_sides(devices, device, **split)
    rows, held = _validation(sides.train, device, validation_share, split.get("seed", 42))
    return train_and_compare(learners, rows, sides.test, sides.features, TARGET, ensemble=ensemble,
                             validation=held, stacks=stacks, ids=[device], keep=[device])


def filled(train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str]) -> list[DataFrame]:
    """The training rows and the others, unknown numbers replaced by the training median (0 if none).

    The medians of a large table take several passes over it, so it should be one that is kept.
    """
    found = column_quantiles(train, columns, {"median": 0.5}, copied=False)
    medians = {r["column"]: r["median"] for r in found.collect()}
    values = {c: float(medians[c]) if medians[c] is not None else 0.0 for c in columns}
    return [df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in values.items()})
            for df in (train, *others)]


def event_sides(events: DataFrame, device: str, c: Columns = Columns(), seed: int = 42) -> Sides:
    """Event rows with plain categories (table 3), split by device and encoded.

    Rows without a target go. Label codes of brand, subsystem and fault, the shares of problem and line, and
    the medians that stand for unknown numbers are learned from the training devices; an unseen category
    gets code -1 and share 0.
    """
    codes = {c.brand: "brand_code", c.subsystem: "subsystem_code", c.fault: "fault_code"}
    shares = {c.problem: "problem_freq", c.line: "line_freq"}
    rows = with_side(events.filter(F.col(EVENT_TARGET).isNotNull()).select(
        device, *V3_HISTORY, *codes, *shares, EVENT_TARGET), device, seed=seed)
    train = rows.filter("not is_test")
    fitted = fit_categories(train, [*codes, *shares])
    _, both = filled(train, [rows.filter("is_test is not null")], V3_HISTORY)
    features = [*V3_HISTORY, *codes.values(), *shares.values()]
    both = encode(both, fitted, codes=codes, shares=shares).fillna(-1, list(codes.values())).fillna(
        0.0, list(shares.values())).select(device, *features, EVENT_TARGET, "is_test")
    return Sides(both.filter("not is_test").drop("is_test"), both.filter("is_test").drop("is_test"), features)


def compare_on_events(events: DataFrame, device: str, learners: Mapping[str, Learner],
                      ensemble: Sequence[str] = (), *, stacks: Mapping[str, Sequence[str]] | None = None,
                      validation_share: float = 0.2, c: Columns = Columns(), seed: int = 42) -> Comparison:
    """The event-level training job: all learners, stacks and ensembles on table 3, one ranked table.

    Folds of a stack and the validation rows are whole devices, so no model is judged on a device it has seen.
    """
    sides = event_sides(events, device, c, seed)
    # The fits and scores read both sides many times.
    sides = Sides(cut_lineage(sides.train), cut_lineage(sides.test), sides.features)
    rows, held = _validation(sides.train, device, validation_share if ensemble else 0.0, seed)
    return train_and_compare(learners, rows, sides.test, sides.features, EVENT_TARGET, ensemble=ensemble,
                             validation=held, stacks=stacks, ids=[device], keep=[device])


def event_predictions(events: DataFrame, device: str, features: Sequence[str], target: str,
                      learner: Learner, keep: int = 10, selector: Learner | None = None,
                      categories: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Event-level control: split by device, top features by a forest, fit, predict.

    Label codes <category>_enc of the categories take part in the choice. Codes and the medians that
    stand for unknown numbers are learned from the training devices; rows without a target go.
    """
    events = cut_lineage(events.select(device, *features, *categories, target)
                         .filter(F.col(target).isNotNull()))
    # The sides are told apart by one row, because every pass over them would move the table to a join.
    rows = with_side(events, device, seed=seed)
    sides = [rows.filter(F.col("is_test") == t).drop("is_test") for t in (False, True)]
    train, test = filled(sides[0], sides[1:], features)
    if categories:
        names = {c: f"{c}_enc" for c in categories}
        fitted = fit_categories(sides[0], categories)
        train, test = (cut_lineage(encode(side, fitted, codes=names).fillna(-1, list(names.values())))
                       for side in (train, test))
        features = [*features, *names.values()]
    chosen = top_features(train, features, target, keep, selector)
    model = fit(learner, train, chosen, target)
    return predict(model, test).select(device, F.col(target).alias("actual"), "predicted")


def device_versus_event(device_predictions: DataFrame, event_rows: DataFrame) -> DataFrame:
    return level_comparison(device_predictions, event_rows, "actual", "predicted")
