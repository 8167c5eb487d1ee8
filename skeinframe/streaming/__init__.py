"""Background jobs, bounded batch streams and event-time windows."""
