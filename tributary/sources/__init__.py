"""Where panels come from and results go to."""
