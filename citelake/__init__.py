"""citelake: legal-citation analytics over large text corpora, on Spark DataFrames."""
