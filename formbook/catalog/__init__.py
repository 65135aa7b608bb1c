"""The query catalogue; importing the modules registers their queries."""

from importlib import import_module

MODULES = ("history", "features_entrant", "features_people", "features_race", "betting", "scoring", "parsing", "diagnostics", "ratings", "models", "streams", "builds", "incremental")


def load_all() -> None:
    for name in MODULES:
        import_module(f"formbook.catalog.{name}")
