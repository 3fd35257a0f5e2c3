"""Configuration of pipelines, on the driver."""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

MODEL = "$model/"


def resolve_models(value: Any, model: str | None, folder: str | None = None, revision: str | None = None, **options: Any) -> Any:
    """A copy of a configuration in which every string ``$model/place[@revision]`` became a description of where that model lies: the checkpoint, the place below the parent's folder, its revision or the parent's."""
    if isinstance(value, dict):
        return {k: resolve_models(v, model, folder, revision, **options) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve_models(v, model, folder, revision, **options) for v in value]
    if not isinstance(value, str) or not value.startswith(MODEL):
        return value
    place, _, own = value.removeprefix(MODEL).partition("@")
    parts = [p for p in (folder and folder.rstrip("/"), place.lstrip("/") if folder else place) if p]
    return {"checkpoint": model, "revision": own or revision, "subfolder": "/".join(parts), "token": options.get("token"), "cache_dir": options.get("cache_dir")}


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float


@dataclass(frozen=True)
class Integer:
    low: int
    high: int


@dataclass(frozen=True)
class Categorical:
    choices: tuple


def draw(space: dict[str, Any], n: int, seed: int = 0) -> Iterator[dict[str, Any]]:
    """n settings of a space of parameters; what is neither a range nor a choice is frozen."""
    rng = random.Random(seed)
    pick = {Uniform: lambda p: rng.uniform(p.low, p.high), Integer: lambda p: rng.randint(p.low, p.high), Categorical: lambda p: rng.choice(p.choices)}
    for _ in range(n):
        yield {k: pick.get(type(p), lambda p: p)(p) for k, p in space.items()}


def grid(**choices: list) -> list[dict[str, Any]]:
    return [dict(zip(choices, values, strict=True)) for values in itertools.product(*choices.values())]


class Hooks:
    """Several observers of a pipeline's steps as one."""

    def __init__(self, *hooks: Callable):
        self.hooks = hooks

    def __call__(self, step: str, df) -> None:
        for hook in self.hooks:
            hook(step, df)


class ArtifactHook:
    """Keeps the DataFrames of the steps, by name."""

    def __init__(self, *steps: str):
        self.steps, self.artifacts = steps, {}

    def __call__(self, step: str, df) -> None:
        if not self.steps or step in self.steps:
            self.artifacts[step] = df


@dataclass
class Space:
    """Parameters of a pipeline: ranges and choices, of which some are frozen; ``instantiate`` takes a value for each that is not."""

    space: dict[str, Any]
    frozen: dict[str, Any] = field(default_factory=dict)

    def freeze(self, **values: Any) -> "Space":
        return Space(self.space, self.frozen | values)

    def instantiate(self, **values: Any) -> dict[str, Any]:
        wanted = set(self.space) - set(self.frozen)
        if unknown := set(values) - wanted:
            raise ValueError(f"not free: {sorted(unknown)}")
        out = self.frozen | {k: v for k, v in self.space.items() if k not in self.frozen and not isinstance(v, (Uniform, Integer, Categorical))} | values
        if missing := wanted - set(out):
            raise ValueError(f"no value for {sorted(missing)}")
        return out

    def trials(self, n: int, seed: int = 0) -> Iterator[dict[str, Any]]:
        return draw(self.space | self.frozen, n, seed)


class Journal:
    """Trials as lines of JSON and the best parameters so far as a JSON file, in a folder of the driver's; a journal that exists is carried on."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        self.path, self.best_path = self.folder / "journal.jsonl", self.folder / "best.json"

    def trials(self) -> list[dict[str, Any]]:
        return [json.loads(x) for x in self.path.read_text().splitlines()] if self.path.exists() else []

    def best(self) -> dict[str, Any] | None:
        return json.loads(self.best_path.read_text()) if self.best_path.exists() else None

    def add(self, params: dict[str, Any], loss: float) -> bool:
        """Whether these are the best parameters yet; only then is their file written anew."""
        with self.path.open("a") as f:
            f.write(json.dumps({"params": params, "loss": loss}) + "\n")
        known = self.best()
        if known is not None and known["loss"] <= loss:
            return False
        self.best_path.write_text(json.dumps({"params": params, "loss": loss}, indent=1))
        return True


def per_task(given: Any, f: Callable[..., Any]) -> Any:
    """Apply f to a table, or to each task's table of a dictionary, list or tuple, in the same form."""
    if isinstance(given, dict):
        return {k: per_task(v, f) for k, v in given.items()}
    if isinstance(given, (list, tuple)):
        return type(given)(per_task(v, f) for v in given)
    return f(given)


class PlanningHook:
    """When each step's plan was made, in seconds since the first: the driver's time, not that of the work, which Spark does when a result is read."""

    def __init__(self) -> None:
        self.times: dict[str, float] = {}
        self._began: float | None = None

    def __call__(self, step: str, df) -> None:
        import time

        self._began = self._began or time.perf_counter()
        self.times[step] = time.perf_counter() - self._began
