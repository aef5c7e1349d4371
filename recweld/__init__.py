"""recweld: record-linkage and corpus analytics on PySpark."""
