"""The cases by name, with the SQL that each must equal."""

QUERIES, ORACLES = {}, {}


def query(name, sql):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add
