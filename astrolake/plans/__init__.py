"""Named queries: every operator bound to the given tables, next to an independent SQL statement."""

from importlib import import_module

MODULES = (
    "stack_queries",
    "image_queries",
    "frame_queries",
    "join_queries",
    "star_queries",
    "select_queries",
    "gate_queries",
    "corpus_queries",
    "ledger_queries",
    "tone_queries",
    "sky_queries",
    "source_queries",
    "stream_queries",
)


def load_all() -> None:
    for module in MODULES:
        import_module(f"astrolake.plans.{module}")
