"""DataFrame operators: ordered neighbours, sweeps, islands, joins, edges, variants and graphs."""
