"""Query plans over the driver tables: fixtures, registry and per-area queries."""
