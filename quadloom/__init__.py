"""quadloom: call-trace and tile-pyramid analytics as Spark DataFrame plans."""
