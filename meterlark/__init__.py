"""meterlark: usage metering, entitlement enforcement and corpus preparation on Spark."""
