"""Column functions: URLs, names, fingerprints and HTTP metadata, all evaluated on the JVM."""
