"""tickloom: market-tick and trade-ledger analytics on Spark DataFrames."""
