"""All registered queries."""

from . import edges, graph, models, relational, whatif  # noqa: F401
from .core import ENTRIES, oracle_sql, spark_query


def spark_queries():
    return {name: spark_query(e) for name, e in ENTRIES.items()}


def oracle_queries():
    return {name: oracle_sql(e.oracle) for name, e in ENTRIES.items() if e.oracle}
