"""Finding, verifying and rewriting personal data in text, as Spark plans."""
