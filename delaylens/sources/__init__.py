"""Sources and sinks: readers, writers and the views over the test tables."""
