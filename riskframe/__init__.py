"""riskframe: cohort analytics and classification benchmarks as Spark DataFrame jobs.

Every operator is a lazy ``DataFrame -> DataFrame`` function or a fit/transform
pair.  Sub-packages: ``sources`` (read, link, write), ``functions`` (row-wise
expressions), ``operators`` (cleaning, labels, profiling, splits, scaling,
selection, neighbours, resampling, clustering, models, evaluation), ``plans``
(compositions: grid search, risk ensemble, study runs, cohort bindings) and
``streaming`` (no streaming exists in the analysed workload).
"""

__version__ = "0.1.0"
