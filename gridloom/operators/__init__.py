"""Frame operators: stages, joins and lookups, windows, positional references and running values."""
