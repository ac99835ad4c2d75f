"""tessera: document matching and record reconciliation on Spark."""
