"""Named queries over the given tables."""
from importlib import import_module

MODULES = ("results", "preparation", "scoring", "metafeatures", "ingestion", "learning")


def load():
    """Import every query module and return the filled registry."""
    for m in MODULES:
        import_module(f"gradus.catalog.{m}")
    return import_module("gradus.catalog.registry")
