"""lexweave sources."""
