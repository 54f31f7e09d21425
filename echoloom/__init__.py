"""echoloom: a Spark-native analytics engine for high-rate waveforms and their feature tables."""
