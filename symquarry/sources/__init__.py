"""Where files and tables come from."""
