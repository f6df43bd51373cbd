"""Where source units come from, and where results go."""
