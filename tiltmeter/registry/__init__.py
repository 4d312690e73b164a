"""Registered queries and their check SQL."""

from . import curate, evaluate, files, language, robust

MODULES = [curate, evaluate, language, robust, files]


def queries():
    return {k: v for m in MODULES for k, v in m.Q.items()}


def oracle_sql():
    return {k: v for m in MODULES for k, v in m.O.items()}
