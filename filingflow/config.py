"""Settings of a run from TOML, with defaults and bounds; a plain value on the driver."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


class FilingError(Exception):
    """The base of what a user can mend."""


class ConfigError(FilingError):
    pass


@dataclass(frozen=True)
class Batch:
    initial_units: int = 20
    min_units: int = 1
    max_units: int = 80
    grow_after_successes: int = 5
    grow_factor: float = 1.25
    shrink_factor: float = 0.5
    max_batch_chars: int = 12_000
    previous_context_chars: int = 3000
    next_context_chars: int = 2000

    def check(self) -> None:
        _need(self.min_units >= 1 and self.max_units >= self.min_units and self.initial_units >= self.min_units, "batch sizes")
        _need(self.max_batch_chars >= 100, "batch.max_batch_chars")


@dataclass(frozen=True)
class Block:
    enabled: bool = False
    max_input_ratio: float = 0.6
    target_batch_units: int = 40
    max_batch_chars: int = 20_000
    max_batches_per_block: int = 20
    max_workers: int = 50
    warmup_delay_seconds: float = 2.0
    before_context_ratio: float = 0.2
    block_body_ratio: float = 0.6
    after_context_ratio: float = 0.2

    def check(self) -> None:
        _need(0 < self.max_input_ratio <= 1, "block.max_input_ratio")
        _need(self.target_batch_units >= 1 and self.max_batch_chars >= 100 and self.max_batches_per_block >= 1 and self.max_workers >= 1 and self.warmup_delay_seconds >= 0, "block limits")
        _need(self.before_context_ratio + self.block_body_ratio + self.after_context_ratio > 0, "block ratios")


@dataclass(frozen=True)
class Model:
    model: str = ""
    base_url: str = ""
    api_key: str = ""
    temperature: float = 0.1
    top_p: float = 0.95
    timeout_seconds: float = 300
    max_retries: int = 3
    context_window_tokens: int = 128_000
    max_output_tokens: int = 4096

    def check(self) -> None:
        _need(bool(self.model), "model.model")


@dataclass(frozen=True)
class Output:
    suffix: str = "_translated"
    report_json: bool = True
    report_markdown: bool = True

    def check(self) -> None:
        _need(bool(self.suffix), "output.suffix")


@dataclass(frozen=True)
class Cache:
    enabled: bool = True

    def check(self) -> None:
        _need(isinstance(self.enabled, bool), "cache.enabled")


@dataclass(frozen=True)
class Config:
    cache: Cache = field(default_factory=Cache)
    batch: Batch = field(default_factory=Batch)
    block: Block = field(default_factory=Block)
    output: Output = field(default_factory=Output)
    model: Model | None = None
    fallback_model: Model | None = None
    target_language: str = "zh-CN"
    email: str | None = None


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(f"bad value: {what}")


def _section(kind: type, table: Any) -> Any:
    """A section; what is missing, or is no table, has its defaults, and unknown keys are ignored."""
    table = table if isinstance(table, dict) else {}
    out = kind(**{f.name: table[f.name] for f in fields(kind) if f.name in table})
    out.check()
    return out


def valid_email(text: str) -> bool:
    return ".." not in text and re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", text) is not None


def loads(text: str) -> Config:
    """The settings of a TOML text; a byte-order mark is tolerated."""
    try:
        data = tomllib.loads(text.removeprefix("﻿"))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    model = data.get("model")
    second = data.get("fallback_model")
    email = data.get("sec", {}).get("email") if isinstance(data.get("sec"), dict) else None
    if email is not None and not valid_email(email):
        raise ConfigError(f"not an e-mail address: {email}")
    translation = data.get("translation") if isinstance(data.get("translation"), dict) else {}
    return Config(
        batch=_section(Batch, data.get("batch")), block=_section(Block, data.get("block")), cache=_section(Cache, data.get("cache")), output=_section(Output, data.get("output")),
        model=_section(Model, model) if isinstance(model, dict) and model.get("model") else None,
        fallback_model=_section(Model, second) if isinstance(second, dict) and second.get("enabled") else None,
        target_language=translation.get("target_language", "zh-CN"), email=email,
    )


#: Fixed value: the key of a template that nobody has filled in.
PLACEHOLDER_KEY = "YOUR_API_KEY"


def need_model(config: Config) -> Model:
    """The model of a run; refused without its address, key and name, or with the template's key."""
    for m in filter(None, (config.model, config.fallback_model)):
        if not (m.base_url.strip() and m.api_key.strip() and m.model.strip()):
            raise ConfigError("a model needs base_url, api_key and model")
    if config.model is None:
        raise ConfigError("no [model] section with base_url, api_key and model")
    if config.model.api_key == PLACEHOLDER_KEY:
        raise ConfigError("[model].api_key must be set")
    return config.model


def default_output(path: str, suffix: str = "_translated") -> str:
    p = Path(path)
    return str(p.with_name(f"{p.stem}{suffix}{p.suffix or '.html'}"))


def report_paths(output: str) -> tuple[str, str]:
    p = Path(output)
    return str(p.with_name(f"{p.stem}_translation_report.json")), str(p.with_name(f"{p.stem}_translation_report.md"))


TEMPLATE = """\
[model]
model = ""
base_url = ""
api_key = "YOUR_API_KEY"

[batch]
initial_units = 20
min_units = 1
max_units = 80

[block]
enabled = true
target_batch_units = 1
max_batch_chars = 80000

[cache]
enabled = true

[translation]
target_language = "zh-CN"

[output]
suffix = "_translated"
"""
