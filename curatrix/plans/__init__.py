"""Registered queries; importing this package's ``q_*`` modules fills the registry."""

from importlib import import_module
from pkgutil import iter_modules

for _m in sorted(m.name for m in iter_modules(__path__) if m.name.startswith("q_")):
    import_module(f"{__name__}.{_m}")
