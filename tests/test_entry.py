"""What the driver calls: queries and SQL with and without the operators on corpora."""

import builtins
import sys

import __spark_entry__
from moraine.plans import registries


def test_core_queries_stay_when_a_library_is_missing(monkeypatch):
    real = builtins.__import__

    def without(name, *args, **more):
        if name.split(".")[0] == "ahocorasick":
            raise ModuleNotFoundError(name)
        return real(name, *args, **more)

    for name in [m for m in sys.modules if m.startswith("moraine.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    core = {k for r in registries() for k in r.queries}
    assert set(__spark_entry__.queries()) == core and set(__spark_entry__.oracle_sql()) <= core


def test_sql_is_for_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
