"""Sources: the series registry, observations derived from order tables, the REST source and its JSON payloads."""
