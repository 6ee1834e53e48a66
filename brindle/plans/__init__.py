"""Plan-level helpers: shared scratch tables that cut lineage, and graph closure."""
