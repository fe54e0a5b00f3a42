"""sightline: code-review analytics on Spark.

Every public function takes DataFrames (and plain parameters) and returns a
DataFrame; nothing is collected to the driver.  Modules:

* ``sources``   readers, fixture views, sinks
* ``functions`` Column -> Column expressions (text, vectors)
* ``operators`` relational building blocks (dataset balancing, similarity joins,
  vocabulary, word pieces, line pairs, labels, metrics, naive Bayes scoring)
* ``plans``     composite jobs (review recommendation, similar lines, corpus jobs)
* ``streaming`` Structured Streaming entry points
"""

__version__ = "0.1.0"
