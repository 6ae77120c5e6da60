"""Area-by-period risk panels on Spark: cleaning, roll-up, time-ordered evaluation and models."""
