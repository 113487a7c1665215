"""The registered queries of the survey engine."""
