"""File, HTTP and table sources, and sinks."""
