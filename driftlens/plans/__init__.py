"""Ready-made plans: test-table adapters, the query catalogue and its SQL counterparts."""
