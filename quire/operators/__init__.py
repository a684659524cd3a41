"""DataFrame operators: trees, plans, rendering, detectors, catalog."""
