"""Answer selection and text curation on Spark DataFrames."""
