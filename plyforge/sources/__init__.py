"""Reading and writing: files, PGN, manifests, results, configuration."""
