"""phasegrid: Spark DataFrame operators for long panels of daily series."""
