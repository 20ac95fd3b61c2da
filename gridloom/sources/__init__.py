"""Views over files, inline tables, and sinks."""
