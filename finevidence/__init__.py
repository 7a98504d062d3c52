"""Evidence tables and statement checks for financial material, on PySpark DataFrames."""
