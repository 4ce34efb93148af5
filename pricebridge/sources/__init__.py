"""Sources: product documents, ceiling-price files, the token-and-page service."""
