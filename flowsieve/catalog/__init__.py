"""Registered queries: every operator on the driver's tables."""

from importlib import import_module

from flowsieve.session import SETTINGS

MODULES = ["network", "frames", "events", "corpus", "models", "streams"]


def _load():
    from flowsieve.catalog import registry
    for name in MODULES:
        import_module(f"flowsieve.catalog.{name}")
    return registry


def _pinned(function):
    """The derived tables need UTC and have long expressions; the rest is left as the session has it."""
    def run(spark, sf_dir):
        for name in ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit"):
            spark.conf.set(name, SETTINGS[name])
        return function(spark, sf_dir)
    run.__doc__ = function.__doc__
    return run


def all_queries():
    return {name: _pinned(function) for name, function in _load().QUERIES.items()}


def all_oracles():
    return dict(_load().ORACLES)
