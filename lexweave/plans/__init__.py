"""lexweave plans."""
