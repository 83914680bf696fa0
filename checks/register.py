"""Registration of queries and their SQL."""

from checks.sql import query


def registry():
    queries, sql = {}, {}

    def check(name, oracle=None):
        def register(run):
            queries[name] = run
            if oracle is not None:
                sql[name] = query(oracle)
            return run

        return register

    return queries, sql, check
