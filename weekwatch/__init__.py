"""Weekly event surveillance over places, written as Spark DataFrame code."""
