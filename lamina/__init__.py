"""lamina: analytics over image volumes, surfaces and text corpora, written as Spark queries."""
