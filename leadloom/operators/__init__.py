"""operators of the site-lead engine."""
