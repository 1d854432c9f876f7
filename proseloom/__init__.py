"""Text-rule analytics on Spark DataFrames."""
