"""Analytics over large collections of radio captures, as Spark jobs."""
