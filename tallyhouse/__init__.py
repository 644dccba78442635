"""Back-office reporting and change jobs as Spark DataFrame programs."""
