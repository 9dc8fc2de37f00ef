"""Runnable queries over the driver tables and the SQL each is checked against."""

import importlib
import pkgutil


def load():
    """Import every check module; return (queries, oracle SQL)."""
    from awardlake.checks import base

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return dict(base.QUERIES), {k: base.expand(v, str) for k, v in base.ORACLES.items()}
