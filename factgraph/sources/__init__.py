"""Tables and fact-graph views."""
