"""All queries outside the optional subpackage, and the SQL that checks them."""

from . import data_queries, graph_queries

QUERIES = {**data_queries.QUERIES, **graph_queries.QUERIES}
ORACLE_SQL = {**data_queries.ORACLE_SQL, **graph_queries.ORACLE_SQL}
