"""Column functions: URLs, HTML and text, JSON-LD, normalisation, page classification."""
