"""Wide per-entity feature tables and ranked, explained scores, as Spark plans."""
