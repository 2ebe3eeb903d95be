"""Where pages come from: the url frontier, HTTP, files and tables."""
