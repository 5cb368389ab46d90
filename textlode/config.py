"""Settings in layers: defaults, the user's file, the project's file, environment, command line. What comes later replaces; rules that
are enabled or disabled add up. A project's file comes with the texts that are scanned, so it may not set what is trusted, and where
it weakens the scan a note says so."""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from .functions.columns import CONFIDENCES, SEVERITIES

PROJECT = os.path.join(".textlode", "config.toml")
MAX_BYTES = 1 << 20

DEFAULTS: dict[str, Any] = {
    "scan.packs": [], "scan.fail_on": "high", "scan.min_severity": "low", "scan.min_confidence": "low", "scan.include": [], "scan.exclude": [], "scan.respect_ignore": True,
    "scan.follow_symlinks": False, "scan.max_file_bytes": 1 << 20, "scan.max_files": 50_000, "scan.max_total_bytes": 512 << 20, "scan.max_stdin_bytes": 16 << 20,
    "scan.baseline": "", "scan.skip_minified": True, "rules.extra_dirs": [], "rules.enable": [], "rules.disable": [], "severity.overrides": {}, "secrets.allow_values": [],
    "suppress.allow_wildcard": False, "exposure.test": ["tests/**", "test/**", "examples/**", "docs/**"], "exposure.vendored": ["vendor/**", "third_party/**"],
    "exposure.internet": ["**/routes/**", "**/api/**", "**/webhooks/**"], "exposure.internal": ["scripts/**", "tools/**", "ops/**"], "classify.rules": [],
    "report.format": "text", "logging.file": "",
}
#: Not from a project's file.
TRUSTED = {"logging.file", "rules.extra_dirs"}
UNIONS = {"rules.enable", "rules.disable"}
_CHOICES = {"scan.fail_on": [*SEVERITIES, "never"], "scan.min_severity": SEVERITIES, "scan.min_confidence": CONFIDENCES, "report.format": ["text", "json", "jsonl", "sarif", "markdown"]}
_SIZES = {k for k in DEFAULTS if k.endswith("_bytes")}


class ConfigError(ValueError):
    pass


def parse_size(text: str | int) -> int:
    """Bytes of 123, 512K, 1.5MB or 2GiB: K, M, G and T are powers of 1,024, and so are KiB and the like; KB and the like are of 1,000."""
    if isinstance(text, int) and not isinstance(text, bool):
        return text
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s*([kmgt]?)(i?)(b?)\s*", str(text), re.I)
    if not m or m[3] and not m[2]:
        raise ConfigError(f"{text!r} is no size")
    step = 1000 if m[2] and m[4] and not m[3] else 1024
    return int(float(m[1]) * step ** " kmgt".index(m[2].lower() or " "))


@dataclass
class Config:
    values: dict[str, Any]
    #: code, message
    notes: list[tuple[str, str]] = field(default_factory=list)

    def __getitem__(self, key: str) -> Any:
        return self.values[key]


def _flat(tree: Mapping, at: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in tree.items():
        name = f"{at}.{k}" if at else k
        if isinstance(v, Mapping) and name not in DEFAULTS:
            out |= _flat(v, name)
        else:
            out[name] = v
    return out


def _checked(key: str, value: Any, where: str) -> Any:
    if key not in DEFAULTS:
        raise ConfigError(f"{where}: no setting is named {key}")
    default = DEFAULTS[key]
    if key in _SIZES:
        return parse_size(value)
    if isinstance(default, bool) != isinstance(value, bool) or not isinstance(value, type(default)):
        raise ConfigError(f"{where}: {key} must be a {type(default).__name__}")
    if key in _CHOICES and value not in _CHOICES[key]:
        raise ConfigError(f"{where}: {key} must be one of {', '.join(_CHOICES[key])}")
    return value


def read(path: str) -> dict[str, Any]:
    if os.path.getsize(path) > MAX_BYTES:
        raise ConfigError(f"{path}: over {MAX_BYTES} bytes")
    try:
        with open(path, "rb") as f:
            return _flat(tomllib.load(f))
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from e


def from_environment(env: Mapping[str, str]) -> dict[str, Any]:
    """TEXTLODE_SCAN_FAIL_ON and the like; lists are parted by commas."""
    out: dict[str, Any] = {}
    for key, default in DEFAULTS.items():
        text = env.get("TEXTLODE_" + key.replace(".", "_").upper())
        if text is None:
            continue
        if isinstance(default, bool):
            if text.lower() not in ("1", "0", "true", "false", "yes", "no"):
                raise ConfigError(f"environment: {key} must be true or false")
            out[key] = text.lower() in ("1", "true", "yes")
        elif isinstance(default, list):
            out[key] = [x.strip() for x in text.split(",") if x.strip()]
        elif isinstance(default, int) and key not in _SIZES:
            out[key] = int(text)
        elif not isinstance(default, dict):
            out[key] = text
    return out


def find_project(start: str) -> str | None:
    """The project's file in a folder or the nearest one above it, no higher than the repository."""
    at = os.path.abspath(start)
    for _ in range(256):
        if os.path.isfile(os.path.join(at, PROJECT)):
            return os.path.join(at, PROJECT)
        if os.path.isdir(os.path.join(at, ".git")) or os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)
    return None


def weakened(key: str, old: Any, new: Any) -> bool:
    """Whether a project's setting lets pass what was found before."""
    if key == "scan.fail_on":
        order = [*SEVERITIES, "never"]
        return order.index(new) > order.index(old)
    if key == "scan.min_severity":
        return SEVERITIES.index(new) > SEVERITIES.index(old)
    if key == "scan.min_confidence":
        return CONFIDENCES.index(new) > CONFIDENCES.index(old)
    if key in ("rules.disable", "scan.exclude", "secrets.allow_values", "severity.overrides", "scan.include", "scan.packs"):
        return bool(new) and new != old
    return key == "suppress.allow_wildcard" and new and not old


def load(project: str | None = None, user: str | None = None, env: Mapping[str, str] = {}, overrides: Mapping[str, Any] = {}, trusted: bool = False) -> Config:
    """project, user: paths of files, where there are such. trusted: the project's file counts as the user's own."""
    out = Config(dict(DEFAULTS))
    layers = [("user", read(user) if user else {}), ("project", read(project) if project else {}), ("environment", from_environment(env)), ("command line", {k: v for k, v in overrides.items() if v is not None})]
    for name, layer in layers:
        for key, value in layer.items():
            value = _checked(key, value, name)
            if name == "project" and not trusted:
                if key in TRUSTED:
                    out.notes.append(("config-untrusted", f"{key} is not taken from a project's file"))
                    continue
                if key == "scan.baseline" and (os.path.isabs(value) or ".." in value.split("/")):
                    out.notes.append(("config-untrusted", f"{key} leads out of the project"))
                    continue
                if weakened(key, out.values[key], value):
                    out.notes.append(("config-weakened", f"the project's file sets {key} to {value!r}"))
            out.values[key] = list(dict.fromkeys(out.values[key] + value)) if key in UNIONS else value
    return out
