"""Scans of large corpora of text, and their preparation for training, on Spark."""

VERSION = "0.2.0"
_NAMES = {
    "scan": "plans.scan", "scan_text": "plans.scan", "sweep": "plans.scan", "Options": "plans.scan", "Result": "plans.scan", "RULES": "rules", "Rule": "rules",
    "load_rules": "packs", "load_config": "config", "reveal": "operators.kernels", "register": "operators.kernels", "redact": "functions.columns",
    "read_baseline": "operators.reports", "write_baseline": "operators.reports", "files": "sources.readers",
}
__all__ = [*_NAMES, "VERSION"]


def __getattr__(name: str):
    """Public names, from the modules that define them, when they are first asked for."""
    import importlib

    if name not in _NAMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_NAMES[name]}"), {"load_config": "load"}.get(name, name))
