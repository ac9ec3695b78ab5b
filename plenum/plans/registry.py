"""Where query modules put their queries and DuckDB statements."""


def registry():
    queries, oracles = {}, {}

    def query(sql: str | None):
        def put(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return put

    return queries, oracles, query
