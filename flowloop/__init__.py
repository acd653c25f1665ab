"""Network-flow scoring with an active-learning loop, on Spark.

``sources``    message streams, hour-partitioned tables, the model store
``functions``  column expressions (addresses, answers, ids, time ranges)
``operators``  DataFrame -> DataFrame steps (decode, normalise, score, label)
``plans``      whole batch jobs built from the operators
``streaming``  the Structured Streaming scoring job
"""
