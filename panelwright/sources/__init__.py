"""Where panels come from and are kept."""
