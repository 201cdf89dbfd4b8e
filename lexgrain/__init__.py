"""lexgrain: document-corpus analytics and retrieval on Spark DataFrames."""
