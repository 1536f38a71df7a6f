"""Analytics over annotated image datasets as Spark DataFrame operators."""
