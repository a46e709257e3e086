"""Set-based jobs over fact-graph tables."""
