"""lexweave: document and library analytics on PySpark DataFrames."""

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a job needs no
# --py-files beyond the driver's own checkout.
cloudpickle.register_pickle_by_value(__import__(__name__))
