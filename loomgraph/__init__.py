"""Code-evidence graph analytics on Apache Spark."""
