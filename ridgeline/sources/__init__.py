"""Row sources and sinks."""
