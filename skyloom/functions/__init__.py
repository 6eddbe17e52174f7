"""functions of the time-series and calendar library."""
