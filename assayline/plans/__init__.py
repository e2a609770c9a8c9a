"""The lab tables over the test data, the registered queries and their reference SQL."""
