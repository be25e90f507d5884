"""Scores of predicted boxes and the registry of reward channels."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import f32
from gridloom.functions.plan import fenced
from gridloom.functions.text import is_one_box, parse_box


# The rewards that models are trained with.
@dataclass(frozen=True)
class RewardRules:
    format_reward: float = 0.5
    coverage_weight: float = 0.6
    precision_weight: float = 0.4
    coverage_floor: float = 0.90
    floor_penalty: float = -1.0
    parse_failure_reward: float = 0.0


def _extent(low: Column, high: Column) -> Column:
    return F.greatest(f32(high - low), f32(F.lit(0)))


def coverage_precision(pred: Sequence[Column], target: Sequence[Column], eps: float = 1e-7) -> tuple[Column, Column]:
    """Share of the target inside the prediction and of the prediction inside the target, as floats.

    Boxes without extent have no area; both are null where a corner of the prediction is.
    """
    p, t = [f32(x) for x in pred], [f32(x) for x in target]
    shared = f32(_extent(F.greatest(p[0], t[0]), F.least(p[2], t[2])) * _extent(F.greatest(p[1], t[1]), F.least(p[3], t[3])))

    def share(box: list[Column]) -> Column:
        area = f32(_extent(box[0], box[2]) * _extent(box[1], box[3]))
        return F.when(p[0].isNotNull(), f32(shared / F.greatest(area, f32(F.lit(eps)))))

    return share(t), share(p)


def box_reward(pred: Sequence[Column], target: Sequence[Column], rules: RewardRules = RewardRules()) -> Column:
    """Nothing parsed, too little covered, or the weighted sum of coverage and precision."""
    coverage, precision = (x.cast("double") for x in coverage_precision(pred, target))
    weighted = F.lit(rules.coverage_weight) * coverage + F.lit(rules.precision_weight) * precision
    return (
        F.when(pred[0].isNull(), F.lit(rules.parse_failure_reward))
        .when(coverage < F.lit(rules.coverage_floor), F.lit(rules.floor_penalty))
        .otherwise(weighted)
    )


def format_reward(text: Column, rules: RewardRules = RewardRules()) -> Column:
    return F.when(is_one_box(text), F.lit(rules.format_reward)).otherwise(F.lit(0.0))


def passes(coverage: Column, precision: Column) -> Column:
    """The benchmark's rule, as documented (fixed values): 90 % covered with 70 % precision."""
    both = (coverage.cast("double") >= F.lit(0.9)) & (precision.cast("double") >= F.lit(0.7))
    return F.coalesce(both, F.lit(False))


#: Reward channels by name; each takes the frame's columns by name, the parsed box as ``_box`` among
#: them, and ignores those it does not need.
Channel = Callable[[dict[str, Column], RewardRules], Column]
CHANNELS: dict[str, Channel] = {}


def channel(name: str) -> Callable[[Channel], Channel]:
    def register(f: Channel) -> Channel:
        CHANNELS[name] = f
        return f

    return register


@channel("format_reward_func")
def _format(columns: dict[str, Column], rules: RewardRules) -> Column:
    return format_reward(columns["completion"], rules)


@channel("asymmetric_bbox_reward_func")
def _box(columns: dict[str, Column], rules: RewardRules) -> Column:
    box = columns["_box"]
    target = [F.get(columns["target_bbox"], F.lit(i)) for i in range(4)]
    return box_reward([box[c] for c in ("x0", "y0", "x1", "y1")], target, rules)


def score(df: DataFrame, rules: RewardRules = RewardRules(), channels: Sequence[str] | None = None) -> DataFrame:
    """``df`` (completion, target_bbox, anything else) with a column per reward channel."""
    df = fenced(df.withColumn("_box", parse_box(F.col("completion"))), "_box")
    columns = {c: F.col(c) for c in df.columns}
    return df.withColumns({name: CHANNELS[name](columns, rules) for name in channels or CHANNELS}).drop("_box")


def channel_means(scored: DataFrame, keys: Sequence[str] = (), channels: Sequence[str] | None = None) -> DataFrame:
    """Mean of every channel, named rewards/<channel>/mean."""
    names = channels or list(CHANNELS)
    return scored.groupBy(*keys).agg(*[F.avg(n).alias(f"rewards/{n}/mean") for n in names])


def zip_rewards(completions: Column, targets: Column, reward: Callable[[Column, Column], Column]) -> Column:
    """A reward per pair of two arrays; the longer one is cut to the shorter."""
    n = F.least(F.size(completions), F.size(targets))
    return F.zip_with(F.slice(completions, F.lit(1), n), F.slice(targets, F.lit(1), n), reward)
