"""DataFrame-to-DataFrame operators.

They run no Spark action, except `jobs.require_targets`, whose point is to fail
on an empty result.
"""
