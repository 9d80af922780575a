import builtins
import importlib
import sys

import __spark_entry__ as entry


def test_queries_stand_without_the_subpackage(monkeypatch):
    real = builtins.__import__

    def refuse(name, *args, **kwargs):
        if name.startswith("corpaudit.llm") or name == "xxhash":
            raise ModuleNotFoundError(f"No module named {name!r}")
        return real(name, *args, **kwargs)

    for name in [n for n in sys.modules if n.startswith("corpaudit.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", refuse)
    names = set(importlib.reload(entry).queries())
    assert "scan" in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
