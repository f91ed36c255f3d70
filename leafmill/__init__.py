"""leafmill: page, chunk, answer and layout analytics as Spark DataFrame programs."""
