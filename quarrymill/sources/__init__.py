"""Sources and sinks of the extraction pipeline: URL lists, run outputs, artifacts, relational tables."""
