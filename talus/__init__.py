"""DataFrame-to-DataFrame operators for cleaning, matching and ranking records on Spark."""
