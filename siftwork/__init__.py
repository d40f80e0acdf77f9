"""siftwork: retrieval, matching and tracking analytics as PySpark DataFrame operators."""
