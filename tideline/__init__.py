"""tideline: labelled time-series queries compiled to Spark DataFrame plans."""
