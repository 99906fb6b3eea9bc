"""See README for the module map."""
