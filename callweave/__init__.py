"""Spark-native analytics over keyed timelines: intervals, events, hops and free text."""
