"""strandwise: k-mer-spectrum analytics and short-read correction on PySpark."""
