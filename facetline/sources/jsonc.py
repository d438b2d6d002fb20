"""Configuration texts: JSON with comments, settings in TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetline.functions.paths import CATEGORIES, INDEX_EXCLUDE
from facetline.functions.text import strip_jsonc


def parse_jsonc(text: Column, schema: str) -> Column:
    """A struct of ``schema``; what is not an object, or broken, has null members."""
    bare = strip_jsonc(text)
    return F.from_json(F.when(bare.rlike(r"^\s*\{"), bare).otherwise(F.lit("{}")), schema)


@dataclass
class Settings:
    overrides: dict[str, list[str]] = field(default_factory=dict)
    exclude: list[str] = field(default_factory=lambda: list(INDEX_EXCLUDE))
    max_bytes: int = 512 * 1024


def load_settings(path: str) -> Settings:
    """Settings of a repository, a small file that the driver reads; a missing file gives the defaults, excludes add to them."""
    settings = Settings()
    if not Path(path).exists():
        return settings
    data = tomllib.loads(Path(path).read_text())
    settings.overrides = {k: list(v) for k, v in data.get("categories", {}).items() if isinstance(v, list) and k in CATEGORIES}
    index = data.get("index", {})
    settings.exclude += list(index.get("exclude", []))
    settings.max_bytes = int(index.get("max_file_kb", settings.max_bytes // 1024)) * 1024
    return settings
