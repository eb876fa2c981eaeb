"""Settings: defaults, a TOML file, and environment variables, in rising order of precedence."""

from __future__ import annotations

import dataclasses
import os
import tomllib
from dataclasses import dataclass, field

PREFIX = "GRAPHLOOM_"


@dataclass
class StorageConfig:
    path: str = "./data"
    compression: str = "snappy"


@dataclass
class ImportConfig:
    batch_size: int = 1000
    skip_invalid: bool = True
    max_errors: int = 100


@dataclass
class LogConfig:
    path: str = "./log"
    segment_size: int = 1000


@dataclass
class AlgorithmConfig:
    pagerank_damping: float = 0.85
    pagerank_max_iterations: int = 100
    pagerank_tolerance: float = 1e-6
    louvain_max_iterations: int = 100
    node2vec_walk_length: int = 80
    node2vec_walks_per_node: int = 10


@dataclass
class Config:
    storage: StorageConfig = field(default_factory=StorageConfig)
    imports: ImportConfig = field(default_factory=ImportConfig)
    log: LogConfig = field(default_factory=LogConfig)
    algorithms: AlgorithmConfig = field(default_factory=AlgorithmConfig)
    spark: dict[str, str] = field(default_factory=dict)


def _coerce(value: object, like: object) -> object:
    if isinstance(like, bool):
        if isinstance(value, bool):
            return value
        if str(value).lower() in ("1", "true", "yes", "on"):
            return True
        if str(value).lower() in ("0", "false", "no", "off"):
            return False
        raise ValueError(f"{value!r} is not a boolean")
    return type(like)(value)


def load(path: str | None = None, environ: dict[str, str] | None = None) -> Config:
    """Unknown keys are errors; ``GRAPHLOOM_SECTION_KEY`` overrides ``[section] key``."""
    environ = dict(os.environ) if environ is None else environ
    config = Config()
    if path:
        with open(path, "rb") as f:
            for section, values in tomllib.load(f).items():
                if section == "spark":
                    config.spark.update({k: str(v) for k, v in values.items()})
                    continue
                part = getattr(config, section, None)
                if part is None:
                    raise ValueError(f"unknown section {section}")
                for k, v in values.items():
                    if not hasattr(part, k):
                        raise ValueError(f"unknown setting {section}.{k}")
                    setattr(part, k, _coerce(v, getattr(part, k)))
    for section in dataclasses.fields(config):
        part = getattr(config, section.name)
        if dataclasses.is_dataclass(part):
            for f in dataclasses.fields(part):
                got = environ.get(f"{PREFIX}{section.name}_{f.name}".upper())
                if got is not None:
                    setattr(part, f.name, _coerce(got, getattr(part, f.name)))
    return config
