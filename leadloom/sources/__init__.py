"""sources of the site-lead engine."""
