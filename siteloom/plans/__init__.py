"""Registered queries by subject; ``all_queries`` gathers them."""


def all_queries() -> tuple[dict, dict]:
    from . import core, landed, traffic, web

    modules = (core, web, traffic, landed)
    return {k: f for m in modules for k, f in m.QUERIES.items()}, {k: s for m in modules for k, s in m.ORACLES.items()}
