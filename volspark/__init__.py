"""Volume analytics and text-corpus operators as Spark jobs."""
