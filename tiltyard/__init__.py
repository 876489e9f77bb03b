"""Head-to-head match analytics on PySpark."""
