"""Query catalogue: each module gives QUERIES (name -> callable) and ORACLES (name -> SQL)."""
