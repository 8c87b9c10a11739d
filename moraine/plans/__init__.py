"""Named queries over the test tables with their SQL twins."""

from importlib import import_module

MODULES = ("changes", "texts", "search", "logs", "relational", "moderation", "learning", "importing", "streams", "rendering")


def registries() -> list:
    return [import_module(f"{__name__}.{m}").registry for m in MODULES]
