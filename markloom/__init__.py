"""Assessment analytics on Spark: segment, judge, validate, score, anchor and report, as DataFrame operators."""
