"""Every operator bound to the test tables, with its SQL twin."""

from corpusloom.catalog import corpora, documents, sites, streams, texts, trees

MODULES = (sites, corpora, texts, trees, documents, streams)


def all_queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
