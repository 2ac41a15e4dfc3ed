"""Controls, joins, windows and aggregations as DataFrame transforms."""
