"""Market monitoring as Spark jobs: search hits, keyword tables, product details and labels as DataFrames."""
