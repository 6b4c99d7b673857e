"""skein: Spark-native triage and similarity analytics over discussion threads."""
