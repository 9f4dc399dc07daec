"""Registered queries: name -> (callable, SQL or None)."""

QUERIES = {}
SQL = {}


def query(sql=None):
    """Register ``fn(spark, sf_dir)`` under its name, with the SQL that checks it."""
    def add(fn):
        name = fn.__name__
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add
