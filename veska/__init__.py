"""veska: panel analytics and data preparation on PySpark DataFrames."""
