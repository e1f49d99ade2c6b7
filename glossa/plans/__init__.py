"""Query plans by subject; load() registers them all."""

from importlib import import_module

MODULES = ["evaluation", "modelling", "deciding", "corpus", "scoring"]


def load() -> None:
    for name in MODULES:
        import_module(f"glossa.plans.{name}")
