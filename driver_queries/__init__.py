"""Registered queries: every operator run over the given tables, with its SQL twin."""


def load_all() -> None:
    """Import every query module so that it registers itself."""
    import importlib

    for name in ("stencils", "scans", "scoring", "tail", "surfaces", "fields", "workflows", "completions"):
        try:
            importlib.import_module(f"driver_queries.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"driver_queries.{name}":
                raise
