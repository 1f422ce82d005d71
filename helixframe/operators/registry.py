"""Named transformers: transform(name, df, option=value, ..)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from helixframe.operators.blocks import block_variants_and_samples
from helixframe.operators.lift_over import lift_over_variants
from helixframe.operators.normalize_variants import normalize_variants
from helixframe.operators.pipe import pipe, pipe_cleanup
from helixframe.operators.split_multiallelics import split_multiallelics

_transformers: dict[str, Callable[..., DataFrame]] = {}


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower().replace("-", "_").replace(" ", "_")


def register_transformer(name: str, f: Callable[..., DataFrame]) -> None:
    _transformers[snake_case(name)] = f


def _plain(value):
    """Options may be texts: numbers, booleans and lists as JSON."""
    if isinstance(value, str) and re.fullmatch(r"-?\d+(\.\d+)?|true|false|True|False|\[.*\]", value.strip()):
        return json.loads(value.lower() if value.lower() in ("true", "false") else value)
    return value


def transform(name: str, df: DataFrame, arg_map: dict | None = None, **options) -> DataFrame:
    """The named transformer's result on df; names and option keys in camel or snake case."""
    key = snake_case(name)
    if key not in _transformers:
        raise ValueError(f"No transformer with name {name}")
    given = {k if k.startswith("env_") else snake_case(k): _plain(v) for k, v in {**(arg_map or {}), **options}.items()}
    return _transformers[key](df, **given)


def _pipe(df: DataFrame, cmd, **options) -> DataFrame:
    env = {k[4:]: str(options.pop(k)) for k in [k for k in options if k.startswith("env_")]}
    cmd = json.loads(cmd) if isinstance(cmd, str) else cmd
    known = {k: v for k, v in options.items() if k not in ("in_validation_stringency", "out_validation_stringency")}
    return pipe(df, list(cmd), env=env, **known)


def _split(df: DataFrame, split_info_fields=None) -> DataFrame:
    fields = [x for x in split_info_fields.split(",") if x] if isinstance(split_info_fields, str) else split_info_fields
    return split_multiallelics(df, fields)


register_transformer("split_multiallelics", _split)
register_transformer("normalize_variants", normalize_variants)
register_transformer("lift_over_variants", lift_over_variants)
register_transformer("block_variants_and_samples", block_variants_and_samples)
register_transformer("pipe", _pipe)
register_transformer("pipe_cleanup", lambda df: pipe_cleanup(df))
