"""Network-security log analytics as DataFrame -> DataFrame functions on Spark."""
