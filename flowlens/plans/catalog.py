"""All registered queries of the packet and flow engine."""

from flowlens.plans import queries, training

QUERIES = queries.QUERIES | training.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | training.ORACLE_SQL
