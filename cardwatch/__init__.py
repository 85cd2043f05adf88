"""cardwatch: card-transaction risk analytics on Spark DataFrames and streams."""
