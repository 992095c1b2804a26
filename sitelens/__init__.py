"""sitelens: documentation-quality analytics on Spark."""
