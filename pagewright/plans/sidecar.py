"""Small JSON files beside the data: what was set up, what is running. Driver-side; never data."""

from __future__ import annotations

import fcntl
import json
import os
import tempfile
from pathlib import Path


def read(path: str) -> dict | None:
    """The file's sections; None if there is none."""
    try:
        return json.loads(Path(path).read_text())
    except FileNotFoundError:
        return None


def write(path: str, held: dict) -> None:
    """The file appears whole or not at all."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w") as f:
            json.dump(held, f, indent=1)
        os.replace(name, target)
    except BaseException:
        os.unlink(name)
        raise


def merge(path: str, patch: dict[str, dict], sections: set[str] | None = None) -> dict:
    """Merge sections key by key, one writer at a time; a section that isn't allowed, or isn't a mapping, is refused before anything changes."""
    for name, body in patch.items():
        if sections is not None and name not in sections or not isinstance(body, dict):
            raise ValueError(f"not a section: {name!r}")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(f"{path}.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        held = read(path) or {}
        for name, body in patch.items():
            held[name] = {**held.get(name, {}), **body}
        write(path, held)
    return held
