"""Column -> Column functions (text cleaning, label encoding, hashing)."""
