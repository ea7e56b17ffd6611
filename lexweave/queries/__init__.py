"""Registered queries and their SQL."""

from lexweave.queries import details, library, records, text

QUERIES = {**text.QUERIES, **library.QUERIES, **records.QUERIES, **details.QUERIES}
ORACLE_SQL = {**text.ORACLE_SQL, **library.ORACLE_SQL, **records.ORACLE_SQL, **details.ORACLE_SQL}
