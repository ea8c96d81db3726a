"""Column expressions: scripts, normalisation, tokens, prompts, citations."""
