"""skeinflow: record-stream analytics as Spark DataFrame programs."""
