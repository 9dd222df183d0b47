"""DataFrame-level operators: rules, joins, threat table, windows."""
