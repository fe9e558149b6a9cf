"""driftline: state estimation and sequential inference over keyed time series, on Spark."""
