"""Evidence-bound analytics on Spark: strict typed operators whose answers trace back to rows."""
