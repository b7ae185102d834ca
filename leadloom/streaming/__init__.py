"""streaming of the site-lead engine."""
