"""Network, cascade and spreading-process analytics as Spark DataFrame operators."""
