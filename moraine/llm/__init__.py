"""Operators on corpora; nothing outside this folder imports it."""

from importlib import import_module

MODULES = ("queries_topn", "queries_residue", "queries_packing", "queries_leaks", "queries_language", "queries_topics", "queries_abuse")


def registries() -> list:
    return [import_module(f"{__name__}.{m}").registry for m in MODULES]
