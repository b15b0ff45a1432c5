"""Transit timetable and network analytics on Spark."""
