"""Column-level functions (regex rules, text normalisation, prompt catalogue)."""
