"""Full-text and JSON containment search over tables, as Spark jobs."""
