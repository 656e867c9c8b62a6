"""corpusflow: building and querying citable text corpora with Spark DataFrames."""
