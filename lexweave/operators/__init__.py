"""lexweave operators."""
