"""Queries over the driver's tables, each with equivalent DuckDB SQL where SQL has a form."""

from chronoweave.queries import alignment, diagnostics, frames, statistics


def queries():
    return alignment.QUERIES | statistics.QUERIES | frames.QUERIES | diagnostics.QUERIES


def oracle_sql():
    return alignment.SQL | statistics.SQL | frames.SQL | diagnostics.SQL
