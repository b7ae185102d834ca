"""plans of the site-lead engine."""
