"""DataFrame -> DataFrame operators (joins, aggregates, windows, reshaping,
sampling, metrics, correlation). Every operator takes column names as
parameters; nothing is tied to one data set."""
