"""Which modules register tables and queries."""

from importlib import import_module

MODULES = ("sources.domain", "operators.staging", "operators.orders", "operators.relational", "operators.inventory", "operators.ledger", "operators.attribution", "operators.quality", "operators.monitoring", "operators.reports", "operators.incremental", "operators.views", "operators.build", "sources.io", "functions.scalar", "streaming.twins")


def load() -> None:
    for name in MODULES:
        import_module(f"brindle.{name}")
