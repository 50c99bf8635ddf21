"""Analytics over packet captures, and over what is derived from them, as Spark programs."""
