"""Registered queries over the given tables, each with equivalent SQL where SQL can say it."""

from . import cleaning, clusters, exploring, features, modelling, profiling, registry, scoring, sources, splitting

MODULES = (sources, profiling, exploring, cleaning, features, splitting, scoring, clusters, modelling, registry)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
