"""functions of the site-lead engine."""
