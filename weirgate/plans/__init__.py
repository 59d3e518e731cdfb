"""End-to-end flows, fixture views and the query catalogue."""
