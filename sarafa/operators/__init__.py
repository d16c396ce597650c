"""DataFrame operators: portfolio, verification, trends, ratios, ranking, text, claims, units, bad rows."""
