"""Training-data operators. Nothing outside this subpackage imports it; `queries` and `oracle_sql` register it."""
