"""Named parts of the engine by group; further packages can add their own, but not replace what is built in."""

from __future__ import annotations

from importlib import import_module
from importlib.metadata import entry_points
from typing import Any

_BUILT_IN = {
    "sources": {"images": "pagewright.sources.files:image_pages", "rows": "pagewright.sources.files:row_pages", "catalog": "pagewright.operators.sampling:stratified_sample", "pages": "pagewright.sources.artifacts:read"},
    "references": {"plain_text": "pagewright.sources.files:text_references", "archive_ocr": "pagewright.sources.files:archive_references"},
    "backends": {"callable": "pagewright.plans.pipeline:recognise", "layout_chat": "pagewright.plans.pipeline:recognise_regions"},
    "normalizers": {"markdown": "pagewright.operators.documents:markdown_document", "layout_json": "pagewright.operators.documents:layout_document"},
    "exports": {"parquet": "pagewright.sources.artifacts:append"},
    "comparisons": {"text": "pagewright.functions.text:text_comparison", "document": "pagewright.operators.documents:deltas", "layout": "pagewright.operators.documents:layout_comparison"},
    "comparison_renderers": {"text": "pagewright.functions.text:row_classes"},
    "benchmarks": {},
    "reporters": {},
    "layout_detectors": {"precomputed": "pagewright.sources.files:precomputed_regions"},
    "runners": {},
}
_own: dict[tuple[str, str], Any] = {}


def groups() -> list[str]:
    return list(_BUILT_IN)


def register(group: str, name: str, value: Any, replace: bool = False) -> None:
    """Add a part; a name that is taken needs replace=True."""
    if group not in _BUILT_IN:
        raise KeyError(f"no such group: {group}")
    if not replace and name in names(group):
        raise ValueError(f"{group} has {name!r} already")
    _own[group, name] = value


def _plugins(group: str) -> dict[str, Any]:
    return {p.name: p for p in entry_points(group=f"pagewright.{group}") if p.name not in _BUILT_IN[group]}


def names(group: str) -> list[str]:
    if group not in _BUILT_IN:
        raise KeyError(f"no such group: {group}")
    return sorted({*_BUILT_IN[group], *_plugins(group), *(n for g, n in _own if g == group)})


def get(group: str, name: str) -> Any:
    """The part, imported when first asked for."""
    if (group, name) in _own:
        return _own[group, name]
    if path := _BUILT_IN.get(group, {}).get(name):
        module, attribute = path.split(":")
        return getattr(import_module(module), attribute)
    if group in _BUILT_IN and name in (found := _plugins(group)):
        return found[name].load()
    raise KeyError(f"{group} has no {name!r}; it has {names(group) if group in _BUILT_IN else 'nothing'}")
