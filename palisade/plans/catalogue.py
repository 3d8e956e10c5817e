"""All queries of the engine, by name, with the SQL that gives the same rows where SQL can."""

from palisade.plans import analytics, behaviour, more, records, scan, stream, text

PARTS = (analytics, text, behaviour, stream, more, scan, records)
QUERIES = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLE = {k: v for p in PARTS for k, v in p.ORACLE.items()}
