"""Text restoration, reconciliation and reporting as Spark plans."""
