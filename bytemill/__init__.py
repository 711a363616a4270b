"""bytemill: byte-chunk analytics as Spark DataFrame plans."""
