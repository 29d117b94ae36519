"""saleloom: panel-sales analytics written on the public Spark APIs."""
