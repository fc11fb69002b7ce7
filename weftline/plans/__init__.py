"""Query catalogues (one module per area) and plan helpers."""
