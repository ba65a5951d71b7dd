"""Structured Streaming: event windows with late data, and refreshes of the graphs as files arrive."""
