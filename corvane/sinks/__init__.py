"""Writers of what the operators make."""
