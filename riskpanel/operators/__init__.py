"""DataFrame operators: columns, filters, joins, aggregates, panels, ordered scans, curves, metrics, models."""
