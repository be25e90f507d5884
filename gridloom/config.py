"""Configuration: frozen settings with the reference values, overridable from YAML and pairs."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace

from gridloom.functions.scoring import RewardRules
from gridloom.functions.text import BOX_FORMAT, PROMPT_TEMPLATE


# The settings that the corpora, the frames and the training runs are defined by.
@dataclass(frozen=True)
class UiCorpus:
    bbox_format: str = "normalized"
    min_box_px: float = 5.0
    min_query_chars: int = 3


@dataclass(frozen=True)
class CellCorpus:
    doc_category: str = "financial_reports"
    split: str = "train"
    min_box_px: float = 5.0
    min_query_chars: int = 3
    max_query_chars: int = 50


@dataclass(frozen=True)
class Config:
    ui: UiCorpus = field(default_factory=UiCorpus)
    cells: CellCorpus = field(default_factory=CellCorpus)
    reward: RewardRules = field(default_factory=RewardRules)
    mix_ratio: tuple[float, float] = (0.7, 0.3)
    holdout_fraction: float = 0.01
    #: ``row``, or ``image``: no screenshot then has rows on both sides.
    holdout_by: str = "row"
    seed: int = 17
    target_size: tuple[int, int] = (1024, 768)
    letterbox_fill: float = 0.0
    margin: float = 0.15
    prompt_template: str = PROMPT_TEMPLATE
    box_format: str = BOX_FORMAT


def override(config, values: dict):
    """``config`` with the nested ``values`` in place of its own; unknown names are an error."""
    known = {f.name for f in fields(config)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    new = {}
    for name, value in values.items():
        old = getattr(config, name)
        new[name] = override(old, value) if is_dataclass(old) else tuple(value) if isinstance(old, tuple) else value
    return replace(config, **new)


def load(path: str | None = None, pairs: tuple[str, ...] = ()) -> Config:
    """Settings of a YAML file, then of ``a.b=value`` pairs."""
    import yaml

    config = Config()
    if path:
        with open(path, encoding="utf-8") as f:
            config = override(config, yaml.safe_load(f) or {})
    for pair in pairs:
        name, _, value = pair.partition("=")
        nested = yaml.safe_load(value)
        for part in reversed(name.split(".")):
            nested = {part: nested}
        config = override(config, nested)
    return config


def as_dict(config: Config) -> dict:
    return asdict(config)
