"""Configuration: defaults, user file, overrides, environment, checks, typed result."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

import yaml

# Defaults.
DEFAULTS: dict[str, Any] = {
    "pipeline": {
        "name": "default",
        "state": {"store": "parquet", "path": ".docforge/state"},
        "stages": {
            "ingest": {"layout_analysis": "light", "ocr": {"enabled": True, "languages": ["chi_sim", "eng"], "min_chars_per_page": 10}},
            "clean": {
                "encoding": "auto",
                "normalize": {"fullwidth_to_halfwidth": True, "traditional_to_simplified": True, "trim_whitespace": True},
                "dedup": {"file_level": {"enabled": True, "method": "hash"}, "paragraph_level": {"enabled": True, "method": "ngram", "threshold": 0.85}},
                "chunking": {"strategy": "structure_aware", "max_size": 500, "overlap": 50, "min_size": 50},
            },
            "embed": {"provider": "hashing", "dimensions": 64, "batch_size": 25, "qps_limit": 10},
        },
        "sinks": [{"type": "markdown", "dir": "00-clean", "include_chunk_markers": True}, {"type": "jsonl", "path": "01-chunks/chunks.jsonl"}],
        "error_handling": {"on_file_failure": "SKIP_AND_LOG", "retry": {"max": 3, "backoff": "exponential", "jitter": True}},
        "concurrency": {"ingest_threads": 4, "clean_threads": 2, "embed_threads": 2, "sink_threads": 2, "queue_capacity": 100},
    }
}
VECTOR_SINKS = ("vectors", "pgvector", "qdrant")


class ConfigError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """Mappings merge, anything else replaces, null included."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def interpolated(value: Any, env: Mapping[str, str]) -> Any:
    """``${NAME}`` and ``${NAME:default}``: a non-empty variable, else the default, else the placeholder."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)(?::([^}]*))?\}", lambda m: env.get(m[1]) or (m[2] if m[2] is not None else m[0]), value)
    if isinstance(value, Mapping):
        return {k: interpolated(v, env) for k, v in value.items()}
    return [interpolated(v, env) for v in value] if isinstance(value, list) else value


def _placed(user: dict[str, Any]) -> dict[str, Any]:
    """Stages may also stand directly below ``pipeline``."""
    pipe = dict(user.get("pipeline") or {})
    loose = {k: pipe.pop(k) for k in ("ingest", "clean", "embed") if k in pipe}
    if loose:
        pipe["stages"] = merged(pipe.get("stages") or {}, loose)
    return {**user, "pipeline": pipe} if "pipeline" in user else user


def dotted(overrides: Mapping[str, Any]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for key, value in overrides.items():
        *path, last = key.split(".")
        at = out
        for name in path:
            at = at.setdefault(name, {})
        at[last] = value
    return out


@dataclass(frozen=True)
class Config:
    name: str
    input: list[str]
    output: str | None
    stages: dict[str, Any]
    sinks: list[dict[str, Any]]
    state: dict[str, Any]
    error_handling: dict[str, Any] = field(default_factory=dict)
    concurrency: dict[str, Any] = field(default_factory=dict)

    @property
    def chunking(self) -> dict[str, Any]:
        return self.stages["clean"]["chunking"]

    @property
    def fingerprint(self) -> str:
        return json.dumps([self.name, self.stages, self.sinks], sort_keys=True, ensure_ascii=False, default=str)

    def job_id(self) -> str:
        return "job-" + hashlib.sha256(f"{','.join(self.input)}|{self.fingerprint}".encode()).hexdigest()[:12]


def load(text: str | None = None, overrides: Mapping[str, Any] | None = None, env: Mapping[str, str] | None = None) -> Config:
    try:
        user = yaml.safe_load(text) if text else {}
    except yaml.YAMLError as error:
        raise ConfigError("CONFIG_001", f"the file is no plain YAML: {error}") from error
    if user is not None and not isinstance(user, Mapping):
        raise ConfigError("CONFIG_001", "the file is no mapping")
    tree = merged(merged(DEFAULTS, _placed(dict(user or {}))), dotted(overrides or {}))
    pipe = interpolated(tree, os.environ if env is None else env)["pipeline"]
    check(pipe)
    inputs = pipe.get("input") or []
    return Config(str(pipe["name"]), [inputs] if isinstance(inputs, str) else list(inputs), pipe.get("output"), pipe["stages"], list(pipe["sinks"] or []), pipe["state"], pipe.get("error_handling") or {}, pipe.get("concurrency") or {})


def check(pipe: Mapping[str, Any]) -> None:
    if not str(pipe.get("name") or "").strip():
        raise ConfigError("CONFIG_002", "pipeline.name is missing")
    c = pipe["stages"]["clean"]["chunking"]
    if not isinstance(c["max_size"], int) or c["max_size"] <= 0:
        raise ConfigError("CONFIG_004", "chunking.max_size must be positive")
    if not 0 <= c["overlap"] < c["max_size"]:
        raise ConfigError("CONFIG_004", "chunking.overlap must be at least 0 and below max_size")
    if c["min_size"] < 0:
        raise ConfigError("CONFIG_004", "chunking.min_size must not be negative")
    embed = pipe["stages"].get("embed") or {}
    if any(s.get("type") in VECTOR_SINKS for s in pipe["sinks"] or []) and embed.get("provider") != "hashing":
        key = str(embed.get("api_key") or "")
        if not key or key.startswith("${"):
            raise ConfigError("CONFIG_003", "a vector sink needs embed.api_key")
