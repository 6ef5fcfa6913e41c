"""Research over document collections, as Spark jobs over tables."""
