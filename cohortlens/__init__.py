"""cohortlens: Spark-native operators for clinical-note cohort building and phenotyping.

Every public operator is DataFrame in, DataFrame out (usable with ``DataFrame.transform``);
no operator collects rows to the driver.
"""

__all__ = ["session"]
