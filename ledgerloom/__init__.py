"""Transaction-ledger analytics and order-return processing as Spark DataFrames."""
