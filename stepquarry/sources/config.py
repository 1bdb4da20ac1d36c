"""Run configuration: defaults under a file's values, and environment files. Plain Python on the driver."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass
from typing import Any


@dataclass
class SearchConfig:
    """Settings of a search; the defaults are fixed values."""

    mode: str = "mcts"
    few_shot_path: str | None = None
    prompt_path: str | None = None
    num_few_shot: int = 4
    step_delim: str = "\n\n"
    temperature: float = 0.7
    top_p: float = 1.0
    max_tokens: int = 2000
    n_generate_sample: int = 1
    step_beam_width: int = 1
    max_depth: int = 4
    iterations: int = 1
    positive_reward: float = 1.0
    negative_reward: float = -1.0
    errors_threshold: int = 0
    need_value_func: bool = False
    update_leaf_value: bool = False
    c_puct: float = 1.5
    remove_duplicate: bool = False
    batch_size: int = -1

    def __post_init__(self) -> None:
        if self.mode not in ("react", "sbs", "mcts"):
            raise ValueError(f"no such mode: {self.mode}")


def merged(defaults: SearchConfig, given: dict[str, Any]) -> SearchConfig:
    """defaults with the given values; unknown names are an error."""
    names = {f.name for f in dataclasses.fields(defaults)}
    if unknown := sorted(set(given) - names):
        raise ValueError(f"unknown settings: {unknown}")
    return dataclasses.replace(defaults, **given)


def load(path: str, defaults: SearchConfig | None = None) -> SearchConfig:
    """A JSON file, or a YAML file where a YAML reader is installed, over the defaults."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith(".json"):
        given = json.loads(text)
    else:
        import yaml

        given = yaml.safe_load(text)
    return merged(defaults or SearchConfig(), given or {})


def load_env(path: str, into: dict[str, str] | None = None) -> dict[str, str]:
    """NAME=value lines of a file, also with `export`, quotes stripped; names that are set already keep their value. A missing file: nothing."""
    into = os.environ if into is None else into
    if not path or not os.path.exists(path):
        return into
    with open(path, encoding="utf-8") as file:
        for line in map(str.strip, file):
            if line and not line.startswith("#") and "=" in line:
                name, value = line.split("=", 1)
                name = name.strip().removeprefix("export ").strip()
                if name and name not in into:
                    into[name] = value.strip().strip("'").strip('"')
    return into
