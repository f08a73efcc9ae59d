"""Settings of a run: defaults, overridden by a file's, overridden by the command line's."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    photons: str | None = None
    als: str | None = None
    output: str | None = None
    extent: str | None = None
    geoid: str | None = None
    target_geoid: str | None = None
    res: float = 20.0
    compat: str = "observed"


def load(path: str | None = None, arguments: list[str] | None = None) -> Config:
    """Values that are absent or None leave what was there."""
    config = Config()
    if path is not None:
        import yaml

        with open(path, encoding="utf-8") as file:
            config = _over(config, yaml.safe_load(file) or {})
    if arguments is not None:
        parser = argparse.ArgumentParser()
        for f in fields(Config):
            parser.add_argument(f"--{f.name.replace('_', '-')}", type=float if f.name == "res" else str)
        config = _over(config, vars(parser.parse_args(arguments)))
    return config


def _over(config: Config, values: dict) -> Config:
    names = {f.name for f in fields(Config)}
    if unknown := set(values) - names:
        raise ValueError(f"no such settings: {sorted(unknown)}")
    return replace(config, **{k: v for k, v in values.items() if v is not None})
