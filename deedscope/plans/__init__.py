"""Building blocks that shape physical plans: lineage, size checks, order, skew."""
