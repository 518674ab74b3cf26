"""Event sources, capture and sinks."""
