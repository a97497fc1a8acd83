"""Call-graph analytics on Spark: definitions, call sites, bindings, levelled graphs and search over source text."""
