"""Reviews and product facts out of stored pages and API bodies."""
