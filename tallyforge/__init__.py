"""tallyforge: evaluation metrics and data curation as PySpark DataFrame operators."""
