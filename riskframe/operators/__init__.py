"""DataFrame operators: every function is lazy and keyed; fitted steps are
pyspark.ml Estimator/Model pairs so they compose in ``pyspark.ml.Pipeline``."""
