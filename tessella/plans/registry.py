"""Configured pipelines: named steps from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Step = Callable[..., DataFrame | None]
STEPS: dict[str, Step] = {}


def step(name: str) -> Callable[[Step], Step]:
    """Registers function(spark, rows, **params) under a name."""

    def register(function: Step) -> Step:
        STEPS[name] = function
        return function

    return register


@dataclass(frozen=True)
class StepConfig:
    name: str
    step: str
    params: dict

    @classmethod
    def of(cls, raw: dict) -> StepConfig:
        """Unknown and missing keys raise."""
        if extra := set(raw) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown keys {sorted(extra)}")
        if raw["step"] not in STEPS:
            raise ValueError(f"unknown step {raw['step']}")
        return cls(raw["name"], raw["step"], dict(raw.get("params") or {}))


def load_config(path: str | Path, section: str) -> list[StepConfig]:
    """The steps of a section of a JSON file, or of a YAML file if a YAML library is there."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yaml", ".yml")):
        import yaml

        raw = yaml.safe_load(text)
    else:
        import json

        raw = json.loads(text)
    return [StepConfig.of(x) for x in raw[section]]


def run_steps(spark: SparkSession, configs: list[StepConfig], rows: DataFrame | None = None) -> DataFrame | None:
    """Applies the steps in order; the plan stays lazy until a step that writes or fits."""
    for c in configs:
        rows = STEPS[c.step](spark, rows, **c.params)
    return rows
