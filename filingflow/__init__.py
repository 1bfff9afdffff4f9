"""filingflow: regulatory-filing unpacking, unit extraction and validation as Spark DataFrames."""
