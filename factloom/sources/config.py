"""Configuration: one TOML file, found beside the project or for the user, with overrides by path."""

from __future__ import annotations

import os
import tomllib
from dataclasses import fields, replace
from pathlib import Path

from factloom.operators.style import Config

#: Names of the project file and of the user's file below the configuration folder.
PROJECT_FILE, USER_FILE = ".factloom.toml", "factloom/config.toml"
_SEVERITIES = {"deny", "warn", "info"}


def find(start: Path | None = None) -> Path | None:
    """The project's file, else the user's; None if there is neither."""
    home = os.environ.get("XDG_CONFIG_HOME") or (os.environ.get("HOME") and f"{os.environ['HOME']}/.config")
    tries = [Path(start or ".") / PROJECT_FILE] + ([Path(home) / USER_FILE] if home else [])
    return next((p for p in tries if p.is_file()), None)


def load(path: Path | str) -> dict:
    return tomllib.loads(Path(path).read_text(encoding="utf-8"))


def check_config(table: dict, base: Config | None = None) -> Config:
    """The checks' limits from a table; names that it does not give keep their value, unknown names are an error."""
    base = base or Config()
    known = {f.name for f in fields(Config)}
    if unknown := set(table) - known:
        raise ValueError(f"unknown setting {sorted(unknown)[0]!r}")
    values = {k: set(v) if k == "disabled" else v for k, v in table.items()}
    return replace(base, **values)


def gate_overrides(table: dict) -> dict[str, str | bool]:
    """rule -> severity, or False for off. True keeps the default and is left out."""
    out: dict[str, str | bool] = {}
    for rule, given in table.items():
        if given is True:
            continue
        if given is not False and given not in _SEVERITIES:
            raise ValueError(f"{given!r} is no severity")
        out[rule] = given
    return out


def for_path(config: Config, overrides: list[tuple[str, dict]], glob: str | None) -> Config | None:
    """The settings of the files whose longest matching glob is ``glob``; None where it turns them off."""
    if glob is None:
        return config
    table = dict(next(t for g, t in overrides if g == glob))
    if table.pop("enabled", True) is False:
        return None
    return check_config(table, config)
