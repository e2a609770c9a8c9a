"""Reading and writing of the lab tables."""
