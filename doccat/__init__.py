"""Document-catalogue analytics on Spark DataFrames.

* ``functions`` -- column expressions: text analysis, XML fields, formatting
* ``operators`` -- DataFrame in, DataFrame out: fields, vectors, similarity, clusters
* ``sources``   -- readers and writers
* ``plans``     -- whole jobs, and the queries registered in ``__spark_entry__.py``
"""
