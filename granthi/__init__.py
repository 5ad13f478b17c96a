"""Set-at-a-time document retrieval and grounded answers on Spark."""
