"""DataFrame operators; every function returns a lazy DataFrame."""
