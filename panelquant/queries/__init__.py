"""Catalogue of runnable queries, one or more per operator, with a SQL twin each."""
from panelquant.queries.base import REGISTRY, SQL  # noqa: F401


def load_all() -> None:
    import importlib
    import pkgutil

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
