"""All registered queries."""

from importlib import import_module

_MODULES = ["flagship", "panel", "urls", "pages", "scores", "market", "timeline", "files"]


def load():
    from .core import QUERIES

    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    return dict(QUERIES)
