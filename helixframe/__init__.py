"""helixframe: sequence-library analytics as Spark DataFrame operators."""
