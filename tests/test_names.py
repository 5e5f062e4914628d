"""Every global name that the library's functions use is defined: a query may be run by no test."""

import builtins
import dis
import importlib
import pkgutil
import types

import tessera


def codes(code):
    yield code
    for c in code.co_consts:
        if isinstance(c, types.CodeType):
            yield from codes(c)


def test_global_names():
    missing = []
    for info in pkgutil.walk_packages(tessera.__path__, "tessera."):
        module = importlib.import_module(info.name)
        source = compile(open(module.__file__).read(), module.__file__, "exec")
        for code in codes(source):
            for i in dis.get_instructions(code):
                if i.opname in ("LOAD_GLOBAL", "LOAD_NAME") and code.co_name != "<module>" and not hasattr(module, i.argval) and not hasattr(builtins, i.argval):
                    missing.append((info.name, code.co_name, i.argval))
    assert [m for m in missing if m[2] not in ("__module__", "__qualname__", "__firstlineno__", "__classdict__", "__annotations__")] == []
