"""Plugins: modules that register pipes, functions, dialects or targets as they are imported.

They are installed top-level modules named wakeline_*, and entry points of the group `wakeline`. The command
line loads them; programs call load(). A plugin that fails to import raises: queries that need it would fail later.
"""

from __future__ import annotations

import importlib
import pkgutil
from importlib.metadata import entry_points

PREFIX = "wakeline_"
GROUP = "wakeline"
_loaded: list[str] = []


def load(force: bool = False) -> list[str]:
    """Import all plugins once (again if forced); their names."""
    if force or not _loaded:
        found = sorted({m.name for m in pkgutil.iter_modules() if m.name.startswith(PREFIX)} | {e.value.partition(":")[0] for e in entry_points(group=GROUP)})
        for name in found:
            importlib.import_module(name)
        _loaded[:] = found
    return list(_loaded)
