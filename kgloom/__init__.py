"""kgloom: a Spark-first engine for evidence-backed knowledge graphs."""
