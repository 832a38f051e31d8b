"""groundsearch: grounded question answering over long documents, on Spark DataFrames."""
