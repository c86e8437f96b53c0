"""Registered queries over the given tables, with equivalent SQL."""

from importlib import import_module

MODULES = [
    "probe_queries", "report_queries", "judge_queries", "corpus_queries", "method_queries",
    "flow_queries",
]


def all_queries():
    from workload.registry import QUERIES

    for m in MODULES:
        import_module(f"workload.{m}")
    return dict(QUERIES)
