"""eventlens: entity x event x binary-outcome analytics on Spark.

Profiles, cleans and joins raw tables, adds leak-free point-in-time
features, prunes correlated columns, splits by time and rebalances, trains
and compares binary classifiers with MLlib, and explains them - each step a
distributed Spark job.
"""

__version__ = "0.1.0"
